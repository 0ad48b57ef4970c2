"""Queries and SQL of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from . import infill, licences, media, merkle, minhash, mixing, negatives, packing, pii, quality, suffixes, warc, windows

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_suffixes": suffixes.op2_suffixes,
    "op3_media": media.op3_media,
    "op4_quality": quality.op4_quality,
    "op5_minhash": minhash.op5_minhash,
    "op6_licences": licences.op6_licences,
    "op7_pii": pii.op7_pii,
    "op8_fingerprints": merkle.op8_fingerprints,
    "op9_mixing": mixing.op9_mixing,
    "op10_warc": warc.op10_warc,
    "op11_windows": windows.op11_windows,
    "op12_infill": infill.op12_infill,
    "op13_negatives": negatives.op13_negatives,
}


def oracle() -> dict[str, str]:
    """SQL of those that it can express; made when asked for, since the licence classifier is fitted for it."""
    return {"op6_licences": licences.oracle(), "op9_mixing": mixing.ORACLE, "op10_warc": warc.ORACLE, "op12_infill": infill.ORACLE, "op13_negatives": negatives.ORACLE}
