"""Rule functions as Columns: query language, type, intents, page types, citations, claims, ids.

Word lists are data: every function takes its own, with the usual ones as defaults.  All run inside the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions import text as T

# ------------------------------------------------------------------------------------- fixed values: word lists

VIETNAMESE_LETTERS = "ăâđêôơưàáạảãằắặẳẵầấậẩẫèéẹẻẽềếệểễìíịỉĩòóọỏõồốộổỗờớợởỡùúụủũừứựửữỳýỵỷỹ"
SAYS_VIETNAMESE = r"(?i)\b(answer|respond|reply|write)\s+(in\s+)?vietnamese\b|\btrả\s*lời\s+bằng\s+tiếng\s+việt\b"
SAYS_ENGLISH = r"(?i)\b(answer|respond|reply|write)\s+(in\s+)?english\b|\btrả\s*lời\s+bằng\s+tiếng\s+anh\b|\bviết\s+bằng\s+tiếng\s+anh\b"
ENGLISH_WORDS = (
    "price cost expensive cheap battery range mileage distance charge charging charger spec specs specification specifications "
    "horsepower torque acceleration dimension weight warranty guarantee compare comparison difference versus better worse between "
    "safety airbag autonomous brake crash what how which does the is are"
).split()

POLICY_SIGNALS = ("bảo hành", "đổi trả", "chính sách", "điều khoản", "hoàn tiền", "bồi thường", "khiếu nại", "điều kiện", "quy định", "cam kết", "thời hạn", "phạm vi bảo hành", "warranty", "policy", "return", "refund", "terms", "conditions", "guarantee", "coverage", "claim")
SPEC_SIGNALS = ("thông số", "kích thước", "công suất", "tốc độ", "pin", "dung lượng", "trọng lượng", "chiều dài", "chiều rộng", "chiều cao", "động cơ", "mã lực", "mô men", "phạm vi", "giá", "giá bán", "giá xe", "bao nhiêu tiền", "màu sắc", "tùy chọn", "phiên bản", "specs", "range", "horsepower", "torque", "weight", "dimensions", "battery", "price", "cost", "how much", "capacity", "power")
FAQ_SIGNALS = ("làm thế nào", "như thế nào", "có thể không", "làm sao", "hướng dẫn", "cách nào", "bằng cách nào", "có được không", "được không", "có hỗ trợ", "tôi có thể", "làm được không", "cách để", "steps", "bước", "how to", "how do", "how can", "can i", "is it possible", "guide")
MANUAL_SIGNALS = ("sử dụng", "vận hành", "bảo dưỡng", "cách dùng", "thao tác", "kết nối", "cài đặt", "thiết lập", "khởi động", "tắt máy", "sạc", "nạp điện", "lái xe", "điều khiển", "operate", "maintain", "connect", "setup", "configure", "charge", "start", "turn on", "turn off", "drive")
QUERY_TYPES = (("policy", POLICY_SIGNALS), ("spec_sheet", SPEC_SIGNALS), ("faq", FAQ_SIGNALS), ("manual", MANUAL_SIGNALS))

MODELS = ("vf3", "vf5", "vf6", "vf7", "vf8", "vf9", "vfe34", "vf e34", "vf34")
INTENTS = {
    "price": ("price", "cost", "how much", "vnd", "million", "expensive", "cheap", "giá", "bao nhiêu", "chi phí", "triệu", "tỷ", "đắt", "rẻ", "mua", "giá bán", "giá xe"),
    "battery_range": ("battery", "range", "km", "distance", "mileage", "pin", "tầm hoạt động", "quãng đường", "ắc quy", "bao xa", "chạy được", "đi được"),
    "charging": ("charge", "charging", "fast charge", "charger", "sạc", "nhanh", "thời gian sạc", "cổng sạc", "trạm sạc"),
    "specs": ("spec", "specification", "motor", "dimension", "size", "weight", "horsepower", "torque", "acceleration", "thông số", "động cơ", "kích thước", "cấu hình", "tốc độ", "khối lượng", "chiều dài", "chiều rộng"),
    "warranty": ("warranty", "guarantee", "service", "bảo hành", "bảo đảm", "bảo dưỡng", "dịch vụ"),
    "comparison": ("compare", "comparison", "difference", "vs", "versus", "better", "worse", "between", "so sánh", "khác nhau", "hơn", "tốt hơn", "thua", "giữa", "hay là", "hay không"),
    "safety": ("safety", "adas", "airbag", "autonomous", "brake", "crash", "an toàn", "túi khí", "phanh", "hỗ trợ lái", "tự lái", "va chạm", "đánh giá an toàn"),
}
VAGUE = ("is it good", "what about it", "tell me more", "details", "more info", "thế nào", "như thế nào", "tốt không", "hay không", "được không", "kể thêm", "thêm thông tin", "cho biết thêm")
CLARIFYING = ("bạn muốn biết gì về", "bạn đang hỏi về", "bạn muốn so sánh", "muốn so sánh", "bạn có thể nói rõ hơn", "bạn có thể làm rõ", "what would you like to know", "which model", "you want to compare", "could you clarify")

GREETINGS = ("alo", "chao", "chao ban", "hello", "hey", "hi", "xin chao", "xin chao ban")
THANKS = ("cam on", "cam on ban", "ok cam on", "thanks", "thank you")
HELP = ("ban co the lam gi", "ban giup duoc gi", "ban la ai", "help", "huong dan", "tro giup")

NOT_FOUND = (
    "không có trong tài liệu được cung cấp", "không tìm thấy trong tài liệu", "không có thông tin trong tài liệu được cung cấp",
    "mình chưa tìm thấy thông tin này trong tài liệu được cung cấp", "khong co trong tai lieu", "khong tim thay trong tai lieu",
    "khong co thong tin trong tai lieu duoc cung cap", "the information is not available in the provided documents",
    "the information is not in the documents", "this information is not available in the provided documents",
    "i could not find this information in the provided documents", "no information found in the provided documents", "not found in the documents",
)

VEHICLE_PAGES = ("dat-coc-xe-dien-vf", "dat-coc-xe-vf", "dat-coc-bo-sung-o-to-dien")
ACCESSORY_PAGES = ("phu-kien", "bo-sac", "op-lung", "tham-lot", "charge-accessories", "green-accessories", "greenaccessories", "green-charge", "greencharge", "thanh-pho-xanh", "v-green", "vgreen", "accessory", "accessories", "lifestyle", "quat-tang", "gift", "merchandise", "clutch", "backpack", "thermos", "embroideredcap", "embroideredpolo", "embroideredtshirt", "scalemodels", "silkscarf")
ACCESSORY_CATEGORY = r"/(?:500[1-9]|5010|6001)(?:$|[\s/?#])"
PAGE_RULES = (("faq", ("cau-hoi-thuong-gap",)), ("news", ("tin-tuc", "thong-bao")), ("charging", ("trạm sạc", "tram-sac", "sac-pin")), ("policy_or_service", ("chinh-sach", "dieu-khoan", "bao-hanh")))

ARTICLE_WORDS = ("tin tuc", "news", "article", "press", "blog", "cong ty", "community")
FAQ_WORDS = ("faq", "cau hoi", "hoi dap", "thuong gap", "questions", "answers")
POLICY_WORDS = ("dieu khoan", "phap ly", "chinh sach", "policy", "privacy", "terms", "quy che", "bao mat")
SERVICE_WORDS = ("dich vu", "bao duong", "bao hanh", "cuu ho", "service", "maintenance", "warranty", "repair")
PRODUCT_WORDS = ("san pham", "product", "chi tiet san pham", "gia ban", "thong so", "dat coc", "mua ngay", "cart", "checkout")
SPEC_WORDS = ("cong suat", "quang duong", "toc do", "kich thuoc", "dung luong", "thoi gian sac", "mo men", "dan dong", "he thong phanh", "pin", "hp", "kw", "kwh", "km/h", "mm", "inch")
#: Ties go to the first.
PAGE_PRIORITY = ("faq", "service", "policy", "article", "product", "listing")

#: Axis, polarity and phrases of statements, in the order they are tried.
MODALITIES = (
    ("recommendation", "recommendation", "negative", ("should not", "not recommended", "do not recommend", "khong nen")),
    ("recommendation", "recommendation", "positive", ("should", "recommended", "recommend", "nen")),
    ("policy", "obligation", "negative", ("not required", "optional", "khong bat buoc")),
    ("policy", "obligation", "positive", ("required", "must", "bat buoc")),
    ("policy", "availability", "negative", ("unsupported", "unavailable", "not supported", "khong ho tro")),
    ("policy", "availability", "positive", ("supported", "available", "ho tro")),
    ("policy", "permission", "negative", ("cannot", "can not", "not allowed", "forbidden", "prohibited", "khong duoc phep", "khong duoc", "cam")),
    ("policy", "permission", "positive", ("allowed", "permitted", "can", "duoc phep")),
)
ACTION_STOPWORDS = ("a", "an", "are", "be", "for", "is", "owners", "owner", "the", "to", "vehicle", "xe")

# ------------------------------------------------------------------------------------------------------ helpers


def any_of(words) -> str:
    """A pattern for any of some plain words."""
    return "|".join(re.escape(w).replace("\\-", "-").replace("\\ ", " ") for w in words)


def contains_any(c: Column, words) -> Column:
    return c.rlike(any_of(words))


def whole_any(c: Column, words, ascii_words: bool = False) -> Column:
    """Whether some word stands alone: beside no letter or digit of any script, or (``ascii_words``) of ASCII."""
    before, after = ("(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])") if ascii_words else (r"\b", r"\b")
    return c.rlike(f"{before}(?:{any_of(words)}){after}")


# ------------------------------------------------------------------------------------------------ query rules


def marked_language(c: Column) -> Column:
    """``vi`` for any Vietnamese letter, else ``en``."""
    return F.when(F.lower(c).rlike(f"[{VIETNAMESE_LETTERS}]"), "vi").otherwise("en")


def query_language(c: Column, before: Column | None = None, detected: Column | None = None, ascii_words: bool = False) -> Column:
    """An explicit wish, else a detector's answer (a seam), else English words, else the language before, else ``vi``."""
    wish = F.when(c.rlike(SAYS_VIETNAMESE), "vi").when(c.rlike(SAYS_ENGLISH), "en")
    words = F.when(whole_any(F.lower(c), ENGLISH_WORDS, ascii_words), "en")
    rest = [x for x in (detected, words, before) if x is not None]
    return F.coalesce(wish, *rest, F.lit("vi"))


def query_type(c: Column, types=QUERY_TYPES) -> Column:
    """The first type with a signal in the question, else ``article``."""
    q, out = F.lower(c), None
    for name, signals in types:
        out = (F if out is None else out).when(contains_any(q, signals), name)
    return out.otherwise("article")


def entities(c: Column, names=MODELS) -> Column:
    """Names that occur anywhere in the text, in the order of the list."""
    return F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower(c), n))


def intents(c: Column, words=INTENTS) -> Column:
    """Intents with a keyword in the text, in their order."""
    q = F.lower(c)
    found = F.array(*[F.when(contains_any(q, keys), name) for name, keys in words.items()])
    return F.filter(found, lambda x: x.isNotNull())


def clarification(question: Column, replying: Column, names=MODELS, words=INTENTS, vague=VAGUE) -> Column:
    """Why a question needs clarification, or the empty string; a reply to a clarification never does."""
    q = F.trim(F.lower(question))
    named, asked, few = F.size(entities(q, names)), intents(q, words), F.size(F.split(q, r"\s+")) <= 4
    return (
        F.when(F.coalesce(replying, F.lit(False)), "")
        .when((named > 0) & (F.size(asked) == 0) & few, "entity_without_intent")
        .when((F.size(asked) > 0) & (named == 0) & few, "intent_without_entity")
        .when(F.array_contains(asked, "comparison") & (named < 2), "comparison_missing_entities")
        .when((named == 0) & contains_any(q, vague), "vague_question")
        .otherwise("")
    )


def asks_clarification(last_answer: Column, markers=CLARIFYING) -> Column:
    """Whether the last answer was a clarifying question."""
    return F.coalesce(contains_any(F.lower(last_answer), markers), F.lit(False))


def small_talk(c: Column) -> Column:
    """``greeting``, ``thanks`` or ``help`` for texts that are nothing else; null otherwise."""
    plain = T.collapse(F.regexp_replace(T.fold(c), r"[^a-z0-9\s]+", " "))
    return F.when(plain.isin(*GREETINGS), "greeting").when(plain.isin(*THANKS), "thanks").when(plain.isin(*HELP), "help")


def dictionary_entities(c: Column, forms: list[tuple[str, str]], least: int = 3) -> Column:
    """Canonical names whose surface forms stand alone in the text, those with the longest forms first, each once.

    ``forms`` are (surface, canonical); a driver-side dictionary, so for thousands join on word windows instead
    (:func:`quarrylake.operators.cluster.linked_entities`).
    """
    known: dict[str, str] = {s.strip().casefold(): canonical for s, canonical in forms if len(s.strip()) >= least}
    hay = F.regexp_replace(c, r"\s+", " ")
    hits = [F.when(hay.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){any_of([s])}(?![\p{{L}}\p{{N}}_])"), canonical) for s, canonical in sorted(known.items(), key=lambda x: -len(x[0]))]
    return F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())) if hits else F.array().cast("array<string>")


def normalised_entities(raw: Column, mapping: dict[str, tuple[str, str]], types) -> Column:
    """Canonical names of raw ones whose type may filter, in order, each once."""
    pairs = [x for k, (canonical, kind) in mapping.items() if kind in types and canonical for x in (F.lit(k), F.lit(canonical))]
    if not pairs:
        return F.array().cast("array<string>")
    found = F.transform(raw, lambda x: F.try_element_at(F.create_map(*pairs), F.trim(x)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


# ------------------------------------------------------------------------------------------------- page rules


def url_fold(c: Column) -> Column:
    """Lower case without accents, white space collapsed; null is empty."""
    return T.fold(F.coalesce(c, F.lit("")))


def page_type(source_type: Column, *fields: Column) -> Column:
    """A coarse type from the source type, or from words in URL and title fields."""
    kind = F.lower(F.trim(F.coalesce(source_type, F.lit(""))))
    hay = F.lower(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]))
    out = F.when((kind != "") & (kind != "url"), kind).when(hay.rlike(ACCESSORY_CATEGORY) | contains_any(hay, ACCESSORY_PAGES), "accessory_page").when(contains_any(hay, VEHICLE_PAGES), "vehicle_page")
    for name, words in PAGE_RULES:
        out = out.when(contains_any(hay, words), name)
    return out.otherwise(F.when(kind == "", "unknown").otherwise(kind))


def price_type(kind: Column) -> Column:
    return F.when(kind == "vehicle_page", "vehicle_price").when(kind == "accessory_page", "accessory_price").otherwise("unknown")


def model_label(c: Column) -> Column:
    """A model named in the text, as it is written in full."""
    number = F.regexp_extract(c, r"(?i)\bVF[\s-]?(3|5|6|7|8|9)\b", 1)
    green = F.regexp_extract(c, r"(?i)\b(minio|herio|nerio|limo)[\s-]?green\b", 1)
    return F.when(number != "", F.concat(F.lit("VF "), number)).when(green != "", F.concat(F.initcap(green), F.lit(" Green"))).when(c.rlike(r"(?i)\bec[\s-]?van\b"), "EC Van")


def page_scores(url: Column, title: Column, markdown: Column, product: Column, price: str = r"(?i)\d[\d.,]*\s*(?:vnd|vnđ|đ|usd|eur|\$)", related: str = r"(?i)\b(?:san pham lien quan|related products|you may also like)\b") -> Column:
    """Weighted rules: ``array<struct<score, place, kind>>`` in order of priority."""
    n = lambda cond, points: F.when(F.coalesce(cond, F.lit(False)), F.lit(points)).otherwise(F.lit(0))
    hay, head = T.fold(F.concat_ws("\n", url, title, F.substring(markdown, 1, 4000))), T.fold(F.concat_ws("\n", url, title))
    priced, tied = F.substring(markdown, 1, 2500).rlike(price), T.fold(markdown).rlike(related)
    lines = F.slice(F.split(markdown, "\n"), 1, 80)
    spec_lines = F.size(F.filter(lines, lambda x: T.fold(x).rlike(any_of(SPEC_WORDS) + r"|\b\d+(?:[.,]\d+)?\s*(?:kw|kwh|km/h|mm|inch|hp|nm)\b")))
    many = lambda c, pattern, least: F.regexp_count(c, F.lit(pattern)) >= least
    product_score = n(product, 4) + n(priced, 2) + n(tied, 2) + n(contains_any(hay, PRODUCT_WORDS), 1) + n(contains_any(hay, SPEC_WORDS), 2) + n(spec_lines >= 6, 2)
    faq = n(contains_any(hay, FAQ_WORDS), 3) + n(contains_any(head, FAQ_WORDS), 3) + n(many(F.substring(markdown, 1, 5000), r"\?", 3), 1)
    policy = n(contains_any(hay, POLICY_WORDS), 3) + n(contains_any(head, POLICY_WORDS), 3) + n(many(markdown, r"(?m)^\s*(?:\d+\.){1,3}\s+", 8), 1)
    service = n(contains_any(hay, SERVICE_WORDS), 3) + n(contains_any(head, SERVICE_WORDS), 3)
    article = n(contains_any(hay, ARTICLE_WORDS), 2) + n(contains_any(head, ARTICLE_WORDS), 3) + n(F.substring(markdown, 1, 8000).rlike(r"\b\d{1,2}/\d{1,2}/\d{4}\b"), 1)
    listing = n(many(markdown, r"(?m)^-\s+", 20) & markdown.rlike(price), 2)
    sold = product_score >= 3
    less = lambda c, by, cond: F.when(cond, F.greatest(F.lit(0), c - by)).otherwise(c)
    served = F.when((service >= 3) & ~priced & ~tied, F.lit(3)).when((service >= 3) & (product_score <= 3), F.lit(2)).otherwise(F.lit(0))
    scores = {"faq": less(faq, 2, sold), "service": service, "policy": less(policy, 1, sold), "article": less(article, 1, sold), "product": F.greatest(F.lit(0), product_score - served), "listing": listing}
    return F.array(*[F.struct(scores[k].cast("int").alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, k in enumerate(PAGE_PRIORITY)])


def page_class(scores: Column) -> Column:
    """The kind with the highest score (ties by priority), ``generic`` without any."""
    best = F.array_max(scores)
    return F.when(best["score"] > 0, best["kind"]).otherwise("generic")


# -------------------------------------------------------------------------------------------- answer rules


def is_not_found(c: Column, phrases=NOT_FOUND) -> Column:
    return F.rtrim(F.lower(F.trim(c)), F.lit(".")).isin(*phrases)


def without_reference_list(c: Column) -> Column:
    """The answer without its trailing lines of references and their heading."""
    listed = r"(?i)(?:(?:^|\n)[^\S\n]*+(?:[-*]?[^\S\n]*\[\d+\][^\n]*+|#*[^\S\n]*\**(?:nguồn|tài liệu tham khảo|sources?|references?)\**[^\S\n]*:?\**)?[^\S\n]*+)++\z"
    return F.trim(F.regexp_replace(F.trim(F.replace(c, F.lit("\r\n"), F.lit("\n"))), listed, ""))


def selected_citations(answer: Column, declared: Column, available: Column, most: int = 3) -> Column:
    """``struct<numbers, decision>``: marks in the text, else declared numbers, else the top ones; invalid numbers select none."""
    marks, asked = T.citation_markers(answer), F.array_distinct(F.coalesce(declared, F.array().cast("array<int>")))
    valid = lambda a: F.forall(a, lambda x: (x >= 1) & (x <= available))
    count = F.least(available, F.greatest(F.size(F.filter(F.split(answer, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")), F.lit(1)), F.lit(most))
    top = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    pick = lambda a, d: F.struct(a.cast("array<int>").alias("numbers"), F.lit(d).alias("decision"))
    return (
        F.when((F.size(marks) > 0) & valid(marks), pick(marks, "answer_markers"))
        .when(F.size(marks) > 0, pick(none, "invalid_answer_markers"))
        .when((F.size(asked) > 0) & valid(asked), pick(asked, "structured_citation_ids"))
        .when(F.size(asked) > 0, pick(none, "invalid_structured_citation_ids"))
        .otherwise(pick(top, "auto_top_evidence"))
    )


def renumbered(answer: Column) -> Column:
    """Citation marks numbered by first use."""
    marks = T.citation_markers(answer)
    held = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1))), answer, lambda s, i: F.when(i <= F.size(marks), F.replace(s, F.concat(F.lit("["), F.element_at(marks, F.least(i, F.greatest(F.size(marks), F.lit(1)))).cast("string"), F.lit("]")), F.concat(F.lit("\u0001"), i.cast("string"), F.lit("\u0002")))).otherwise(s))
    return F.when(F.size(marks) > 0, F.translate(held, "\u0001\u0002", "[]")).otherwise(answer)


def declared_citations(payload: Column) -> Column:
    """Whole numbers, or strings of digits, of a JSON object's citation list, in order, each once; booleans aren't numbers."""
    raw = F.coalesce(F.get_json_object(payload, "$.used_citation_ids"), F.get_json_object(payload, "$.used_citations"))
    items = F.from_json(raw, "array<string>")
    digits = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.rlike(r"^\d{1,9}$"))
    return F.coalesce(F.array_distinct(F.transform(digits, lambda x: x.cast("int"))), F.array().cast("array<int>"))


def flattened_ids(c: Column) -> Column:
    """Ids of a JSON array or string, or of a comma-separated cell, in order, each once."""
    listed = F.from_json(c, "array<string>")
    cells = F.split(F.coalesce(F.when(c.rlike(r'^\s*"'), F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0]), c), ",")
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.when(c.rlike(r"^\s*\["), listed), cells), lambda x: F.trim(x)), lambda x: x != ""))


def short_list(c: Column, most: int = 8) -> Column:
    """Trimmed, non-blank, each once whatever its case (the first spelling stays), at most so many."""
    clean = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    first = F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def one_of(c: Column, allowed, default: str = "unknown") -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*allowed), low).otherwise(default)


def quality_score(c: Column) -> Column:
    """A number in text, cut to 0..1; booleans and words are none."""
    n = c.try_cast("double")
    return F.when(n.isNotNull(), T.clamp(n, 0.0, 1.0))


# ------------------------------------------------------------------------------------------------ claims, ids


def entity_names(c: Column, pattern: str = r"(?i)\b(?:\p{L}+\s+)?vf\s*-?\s*[0-9][a-z0-9]*(?:\s+plus)?\b") -> Column:
    """Entities of a text in upper case, in order, each once; ``global`` if none."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.upper(T.collapse(x))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("global")))


def first_entity(c: Column, pattern: str = r"(?i)\bvf\s*-?\s*[0-9][a-z0-9]*(?:\s+plus)?\b") -> Column:
    found = T.plain_key(F.regexp_extract(c, pattern, 0))
    return F.when(found != "", found).otherwise("global")


def semantic_claim(c: Column, modalities=MODALITIES) -> Column:
    """``struct<kind, axis, polarity, entity, action>`` of the first phrase that holds; null without one."""
    key, entity = T.plain_key(c), first_entity(c)
    out = None
    for kind, axis, polarity, phrases in modalities:
        for phrase in phrases:
            word = rf"\b{any_of([phrase])}\b"
            action = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(key, word, " ")), r"\s+"), lambda w: (w != "") & ~w.isin(*ACTION_STOPWORDS)))
            made = F.struct(F.lit(kind).alias("kind"), F.lit(axis).alias("axis"), F.lit(polarity).alias("polarity"), entity.alias("entity"), F.array_except(action, F.split(entity, " ")).alias("action"))
            out = (F if out is None else out).when(key.rlike(word), made)
    return out


def has_context(c: Column, at: Column, words=("bao hanh", "warranty", "guarantee"), reach: int = 80) -> Column:
    """Whether a word stands within so many characters of a place (from 0)."""
    low = F.greatest(at - reach, F.lit(0))
    return contains_any(T.fold(F.substr(c, low + 1, at + reach - low)), words)


def claim_id(method: Column, kind: Column, ids: Column) -> Column:
    return F.concat(F.lit("kq-"), F.substring(F.sha1(F.concat_ws(":", method, kind, F.array_join(F.array_sort(ids), "|"))), 1, 12))


def fact_id(chunk: Column, entity: Column, attribute: Column, value: Column, index: Column) -> Column:
    return F.concat(F.lit("fact-"), F.substring(F.sha1(F.concat_ws("|", chunk.cast("string"), entity, attribute, value, index.cast("string"))), 1, 12))


def safe_filename(c: Column) -> Column:
    """The last part of a path with anything odd replaced; ``document`` if nothing is left."""
    name = F.regexp_replace(F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1), r"[^A-Za-z0-9._-]+", "_")
    name = F.regexp_replace(name, r"^[._]+|[._]+$", "")
    return F.when(name == "", "document").otherwise(name)


def document_prefix(chunk_id: Column) -> Column:
    return F.substring_index(chunk_id, "_", 2)


def chunk_number(chunk_id: Column) -> Column:
    return F.regexp_extract(chunk_id, r"_c(\d+)$", 1).try_cast("int")


def pages_of(pages: Column, page_range: Column, page: Column) -> Column:
    """Page numbers: a list sorted, else a range like 3-5, else the one page; an empty list without any."""
    low, high = (F.regexp_extract(page_range, r"^\s*(\d+)\s*-\s*(\d+)\s*$", k).try_cast("int") for k in (1, 2))
    return F.coalesce(F.when(F.size(pages) > 0, F.array_sort(F.array_distinct(pages))), F.when(low <= high, F.sequence(low, high)), F.when(page.isNotNull(), F.array(page)), F.array().cast("array<int>"))


def parser_score(terms_found: Column, terms: Column, sections_found: Column, sections: Column) -> Column:
    """0.8 of the terms' recall and 0.2 of the sections'; nothing expected counts as found."""
    share = lambda a, n: F.when(n == 0, F.lit(1.0)).otherwise(a / n)
    return F.round(0.8 * share(terms_found, terms) + 0.2 * share(sections_found, sections), 4)
