"""Dimensions of the spending domain, as fixed values."""

from __future__ import annotations

#: Category keys, their display names and budget buckets.
CATEGORY_DISPLAY = {
    "makanan_minuman": "Makanan & Minuman",
    "transportasi": "Transportasi",
    "belanja": "Belanja & Retail",
    "hiburan": "Hiburan & Wisata",
    "kesehatan": "Kesehatan",
    "pendidikan": "Pendidikan",
    "tagihan": "Tagihan & Utilitas",
    "lainnya": "Lainnya",
}
NEEDS = ("makanan_minuman", "transportasi", "tagihan", "kesehatan", "pendidikan")
BUCKETS = ("kebutuhan", "keinginan", "tabungan")
IDEAL = {"kebutuhan": 0.5, "keinginan": 0.3, "tabungan": 0.2}
DEFAULT_CATEGORY, DEFAULT_BUCKET = "lainnya", "keinginan"
#: Month names of labels, and month words that dates are written with.
MONTH_NAMES = ("Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember")
SHORT_MONTHS = ("Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des")
MONTH_WORDS = {
    1: ("jan", "januari"), 2: ("feb", "februari"), 3: ("mar", "maret"), 4: ("apr", "april"), 5: ("may", "mei"), 6: ("jun", "juni"),
    7: ("jul", "juli"), 8: ("aug", "agu", "ags", "agustus"), 9: ("sep", "sept", "september"), 10: ("okt", "oct", "oktober", "october"),
    11: ("nov", "november"), 12: ("des", "dec", "desember", "december"),
}
SOURCE_LABELS = {"receipt": "Struk", "screenshot": "Screenshot", "manual": "Manual"}
STATUSES = ("extracted", "needs_review", "failed")
#: Public document types and the internal types behind them.
SCREENSHOT_TYPES = ("mbanking_transaction_detail", "compact_qr", "compact_qr_card", "qris", "ewallet", "ewallet_receipt_screen", "payment_screenshot", "screenshot")
RECEIPT_TYPES = ("receipt", "photo_receipt", "shopping_receipt")
DOCUMENT_LABELS = {"receipt": "Struk Belanja", "screenshot": "Screenshot Pembayaran", "unknown": "Perlu dicek manual"}
#: Category keywords, in the order in which categories are tried.
KEYWORDS = {
    "tagihan": (
        "tagihan", "bill", "bills", "utility", "utilities", "langganan", "subscription", "membership", "member", "monthly", "insurance", "asuransi", "cicilan", "angsuran", "pln",
        "listrik", "electricity", "pdam", "token listrik", "internet", "wifi", "pulsa", "paket data", "telkom", "telkomsel", "indihome", "xl", "axis", "indosat", "simpati", "by.u",
        "tri", "smartfren", "firstmedia", "myrepublic", "biznet", "kartu halo", "bpjs", "gobills", "gopay bills",
    ),
    "kesehatan": (
        "dokter", "doctor", "klinik", "clinic", "apotek", "apotik", "pharmacy", "dental", "dentist", "hospital", "rumah sakit", "medical", "obat", "medicine", "lab", "laboratorium",
        "laboratory", "puskesmas", "optik", "optic", "fisioterapi", "poli ", "halodoc", "alodokter", "kimia farma", "kimiafarma", "k24", "guardian",
    ),
    "pendidikan": (
        "sekolah", "school", "kampus", "campus", "university", "universitas", "course", "kursus", "class", "kelas", "training", "bootcamp", "education", "pendidikan", "tuition", "les",
        "bimbel", "privat", "tutor", "edukasi", "academy",
    ),
    "makanan_minuman": (
        "gofood", "grabfood", "grab food", "shopeefood", "shopee food", "goeat", "food", "drink", "beverage", "makanan", "minuman", "meal", "snack", "kitchen", "dessert", "catering",
        "eatery", "dining", "cafe", "kafe", "coffee", "kopi", "warkop", "resto", "restaurant", "restoran", "warung", "warteg", "kedai", "kantin", "rumah makan", "depot", "dapur",
        "waroenk", "bakery", "bakeri", "bread", "roti", "cake", "cakes", "donut", "mcdonald", "mc donald", "kfc", "kentucky", "pizza hut", "burger king", "starbuck", "j.co", "jco",
        "chatime", "breadtalk", "hokben", "yoshinoya", "marugame", "gyu-kaku", "ichiban sushi", "mie gacoan", "geprek", "mixue", "sour sally", "es teler", "nasi", "mie", "mi", "ayam",
        "bakso", "bakmi", "sop", "soto", "sate", "seafood", "ikan", "daging", "sayur", "tahu", "tempe", "gado", "ketoprak", "bubur", "rendang", "padang", "rawon", "pecel", "siomay",
        "lontong", "ketupat", "batagor", "kwetiau", "pempek", "mpek", "coto", "martabak", "terang bulan", "molen", "takoyaki", "gorengan", "cilok", "cireng", "lalapan", "kue", "jajan",
        "juice", "jus", "milk", "susu", "smoothie", "boba", "bubble tea", "teh", "matcha", "es krim", "ice cream", "gelato", "mochi", "pocari", "aqua", "cimory", "aice", "chicken",
        "beef", "fish", "pork", "burger", "pizza", "sandwich", "ramen", "sushi", "curry", "noodle", "dimsum", "shawarma", "kebab", "waffle", "pancake", "crepe",
    ),
    "transportasi": (
        "transport", "transportation", "parkir", "parking", "tol", "toll", "spbu", "fuel", "bensin", "bbm", "pertamina", "shell", "vivo", "taxi", "taksi", "ride", "travel", "kereta",
        "bus", "gojek", "goride", "gocar", "grab", "grabcar", "grabbike", "indriver", "maxim", "ojek", "blue bird", "bluebird", "rental", "sewa kendaraan", "pesawat", "tiket pesawat",
        "kereta api", "kai", "damri", "pelni", "ferry", "airport",
    ),
    "hiburan": (
        "hiburan", "entertainment", "wisata", "movie", "cinema", "bioskop", "game", "games", "ticket", "tiket", "karaoke", "event", "konser", "concert", "museum", "streaming", "gym",
        "fitness", "sport", "olahraga", "yoga", "pilates", "spa", "salon", "barbershop", "barber", "hotel", "penginapan", "hostel", "airbnb", "taman ", "wahana", "resort", "villa",
        "netflix", "spotify", "youtube premium", "disney", "vidio", "mola", "laundry", "dry clean", "laundromat", "cuci ",
    ),
    "belanja": (
        "shop", "store", "toko", "retail", "market", "supermarket", "minimarket", "groceries", "grocery", "mall", "fashion", "clothing", "shoes", "aksesoris", "accessories",
        "swalayan", "alfamart", "indomaret", "alfamidi", "hypermart", "carrefour", "giant", "lottemart", "transmart", "shopee", "tokopedia", "lazada", "blibli", "bukalapak",
        "matahari", "ramayana", "metro", "centro",
    ),
}
POPULAR_MERCHANTS = ("Alfamart", "Indomaret", "Alfamidi", "Shopee", "Tokopedia", "Lazada", "Mixue", "Mie Gacoan")
