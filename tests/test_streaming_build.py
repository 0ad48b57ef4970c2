"""A batch that fails, at any point, and is tried again leaves each path once."""

import json

import pytest
from pyspark.errors import StreamingQueryException

from tallyforge.sources import loaders
from tallyforge.streaming import build


def put(folder, name, ids):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"file_name": f"bank/{i}.png", "ground_truth": json.dumps({"gt_parse": {"recipient": f"r{i}", "amount": "5.000"}})}) for i in ids))


@pytest.mark.parametrize("point", ["before", "after"])
def test_a_killed_batch_is_done_once(spark, tmp_path, point):
    out, checkpoint, source = str(tmp_path / "out"), str(tmp_path / "checkpoint"), tmp_path / "in"
    rows = lambda: loaders.mbanking(build.records(spark, str(source), files=1)).select("path", "merchant", "total")
    put(source, "a.json", [1, 2, 2])
    build.build(rows(), out, checkpoint).awaitTermination()
    put(source, "b.json", [2, 3, 4])
    whole = build.once(out)

    def dies(batch_rows, batch):
        if point == "after":
            whole(batch_rows, batch)
        raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        build.build(rows(), out, checkpoint, sink=dies).awaitTermination()
    put(source, "c.json", [4, 5])
    for _ in range(2):  # the second finds nothing new
        build.build(rows(), out, checkpoint).awaitTermination()
        assert sorted(r["path"] for r in build.built(spark, out).collect()) == [f"bank/{i}.png" for i in (1, 2, 3, 4, 5)]


def test_images_come_as_a_stream(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.png").write_bytes(b"123")
    (tmp_path / "in" / "deep" / "b.jpg").write_bytes(b"1")
    (tmp_path / "in" / "c.txt").write_bytes(b"1")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    assert build.built(spark, out) is None
    for _ in range(2):
        build.build(build.images(spark, str(tmp_path / "in")), out, checkpoint).awaitTermination()
        assert sorted((r["path"].rpartition("/")[2], r["length"]) for r in build.built(spark, out).collect()) == [("a.png", 3), ("b.jpg", 1)]
