"""The rule engine for review texts: sentiment, category, urgency, replies and product kinds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER, PRAISE = "อื่น ๆ", "เชิงบวก/ชม"

# Word lists, in the order in which they decide.
POSITIVE_WORDS = ["ดี", "ชอบ", "ประทับใจ", "คุ้ม", "เร็ว", "สวย", "ของแท้", "แนะนำ", "ถูกใจ", "ใช้ดี", "ตรงปก", "บริการดี", "great", "good", "love", "nice"]
NEGATIVE_WORDS = ["แย่", "ห่วย", "ช้า", "พัง", "เสีย", "ผิด", "ไม่ดี", "ไม่ตรงปก", "ปลอม", "โกง", "หลอก", "ผิดหวัง", "แพง", "bad", "terrible", "slow", "broken"]
NEGATION = "ไม่"
CATEGORY_WORDS = {
    "ความปลอดภัย/สุขภาพ": ["แพ้", "ผื่น", "คัน", "ระคายเคือง", "อันตราย", "หมดอายุ", "เน่า", "ขึ้นรา", "บวม", "แสบ", "ปวด"],
    "การจัดส่ง": ["ส่ง", "จัดส่ง", "ขนส่ง", "พัสดุ", "ช้า", "นาน", "ไม่ได้ของ", "ของหาย", "ตกหล่น", "kerry", "flash", "ล่าช้า", "ส่งผิด", "รอนาน", "ส่งเร็ว", "ส่งไว"],
    "บรรจุภัณฑ์": ["กล่อง", "แพ็ค", "ห่อ", "บุบ", "บรรจุภัณฑ์", "ซีล", "แตกหัก", "หีบห่อ", "กันกระแทก"],
    "การชำระเงิน": ["จ่าย", "ชำระ", "โอน", "เก็บเงินปลายทาง", "ปลายทาง", "payment", "บัตร", "หักเงิน", "คิดเงิน"],
    "ราคา/โปรโมชั่น": ["ราคา", "แพง", "ถูก", "โปร", "ส่วนลด", "คูปอง", "คุ้ม", "โปรโมชั่น", "ลดราคา", "แถม"],
    "การบริการ/แอดมิน": ["แอดมิน", "ตอบ", "บริการ", "ทักแชท", "ไม่ตอบ", "มารยาท", "พูดจา", "ร้านดี", "ร้านน่ารัก", "ตอบเร็ว", "ตอบช้า"],
    "คุณภาพสินค้า": ["พัง", "เสีย", "ชำรุด", "แตก", "ไม่ตรงปก", "ปลอม", "ของแท้", "คุณภาพ", "ใช้ไม่ได้", "ห่วย", "ของดี", "ใช้ดี", "ตรงปก", "งานดี", "ของไม่ดี", "ไม่เหมือนรูป"],
}
DANGER_WORDS = ["หลอกลวง", "โกง", "ของปลอม", "ไม่ได้ของ", "ฟ้องร้อง", "สคบ", "ทนายความ", "แพ้", "ผื่น", "อันตราย", "หมดอายุ", "ขึ้นรา", "เน่า", "ไฟไหม้", "ระเบิด", "ช็อต", "scam", "fake", "lawyer", "dangerous", "expired"]
WARNING_WORDS = ["ไม่ส่ง", "ทักแล้วเงียบ", "ตอบแล้วเงียบ", "เงียบหาย", "ติดต่อไม่ได้", "ไม่ตอบแชท", "รีฟัน", "คืนเงิน", "ขอเงินคืน", "refund"]
KNOWN_CATEGORIES = ["คุณภาพสินค้า", "การจัดส่ง", "การบริการ/แอดมิน", "ราคา/โปรโมชั่น", "บรรจุภัณฑ์", "ความปลอดภัย/สุขภาพ", "การชำระเงิน", OTHER, PRAISE]
PRODUCT_WORDS = {
    "health_air": ["หน้ากาก", "mask", "n95", "kf94", "ฟอกอากาศ", "air purifier", "purifier", "แผ่นกรอง", "filter", "ยาดม", "เครื่องวัดฝุ่น", "อากาศ"],
    "skincare_beauty": ["กันแดด", "sunscreen", "spf", "ครีม", "cream", "โลชั่น", "lotion", "เซรั่ม", "serum", "บำรุงผิว", "มาส์ก", "mask sheet", "ลิป", "lip", "แป้ง", "รองพื้น", "เครื่องสำอาง", "cosmetic", "makeup", "บำรุง", "essence", "moistur"],
    "apparel_fashion": ["เสื้อ", "shirt", "กางเกง", "pants", "เดรส", "dress", "กระโปรง", "skirt", "รองเท้า", "shoe", "sneaker", "แจ็คเก็ต", "jacket", "เสื้อกันหนาว", "hoodie", "ชุด", "ถุงเท้า", "หมวก", "เสื้อกันฝน", "ร่ม", "umbrella"],
    "home_cooling": ["พัดลม", "fan", "แอร์", "เครื่องปรับอากาศ", "air condition", "พัดลมไอเย็น", "cooler", "เครื่องทำน้ำเย็น"],
    "supplement_med": ["วิตามิน", "vitamin", "อาหารเสริม", "supplement", "คอลลาเจน", "collagen", "ยา ", "เวย์", "whey", "โปรตีน", "protein"],
    "food_beverage": ["ขนม", "snack", "เครื่องดื่ม", "กาแฟ", "coffee", "ชา ", "นม", "milk", "อาหาร", "food", "น้ำ", "ลูกอม", "ช็อกโกแลต"],
    "electronics": ["สายชาร์จ", "cable", "ชาร์จ", "charger", "อะแดปเตอร์", "adapter", "powerbank", "พาวเวอร์แบงค์", "power bank", "หูฟัง", "earbud", "earphone", "headphone", "ลำโพง", "speaker", "เคส", "case", "ฟิล์ม", "screen protector", "เมาส์", "mouse", "keyboard", "คีย์บอร์ด", "usb", "type-c", "type c", "hub", "iphone", "ipad", "samsung", "notebook", "laptop", "tablet", "โทรศัพท์", "มือถือ", "android", "charge", "watt", "240w", "gan"],
}
WEATHER_FACTORS = {"health_air": ["pm2_5"], "skincare_beauty": ["temp_mean"], "apparel_fashion": ["temp_mean", "precip"], "home_cooling": ["temp_mean"], "supplement_med": ["pm2_5"], "food_beverage": ["temp_mean"], "electronics": [], "generic": []}

# Reply texts by category, several for positive comments, and the rest.
CATEGORY_REPLIES = {
    "การจัดส่ง": "ขออภัยในความล่าช้าของการจัดส่งด้วยนะคะ ทางร้านจะรีบตรวจสอบสถานะพัสดุและเร่งติดตามให้ทันที รบกวนแจ้งเลขออเดอร์เพิ่มเติมทางแชทได้เลยค่ะ",
    "คุณภาพสินค้า": "ขออภัยที่สินค้ามีปัญหาด้วยนะคะ ทางร้านยินดีดูแลเปลี่ยน/คืนสินค้าให้ค่ะ รบกวนส่งรูปสินค้าและเลขออเดอร์มาทางแชทเพื่อดำเนินการเคลมให้ทันทีค่ะ",
    "การบริการ/แอดมิน": "ขออภัยในความไม่สะดวกด้วยนะคะ ทางร้านน้อมรับและจะปรับปรุงการบริการให้ดียิ่งขึ้น หากมีข้อสงสัยเพิ่มเติมทักแชทมาได้ตลอดเลยค่ะ",
    "ราคา/โปรโมชั่น": "ขอบคุณสำหรับความคิดเห็นนะคะ ทางร้านมีโปรโมชั่นและส่วนลดสำหรับลูกค้าเป็นประจำ ฝากกดติดตามร้านเพื่อรับสิทธิ์ก่อนใครนะคะ",
    "บรรจุภัณฑ์": "ขออภัยเรื่องบรรจุภัณฑ์ด้วยนะคะ ทางร้านจะปรับการแพ็คให้แน่นหนายิ่งขึ้น หากสินค้าเสียหายรบกวนแจ้งพร้อมรูปเพื่อเคลมให้เลยค่ะ",
    "ความปลอดภัย/สุขภาพ": "ขออภัยอย่างยิ่งค่ะ เรื่องความปลอดภัยเราให้ความสำคัญสูงสุด รบกวนหยุดใช้สินค้าก่อนและติดต่อทางร้านโดยด่วน เพื่อตรวจสอบและดูแลรับผิดชอบให้เต็มที่ค่ะ",
    "การชำระเงิน": "ขออภัยเรื่องการชำระเงินด้วยนะคะ รบกวนแจ้งรายละเอียด/หลักฐานการชำระมาทางแชท ทางร้านจะรีบตรวจสอบและแก้ไขให้ทันทีค่ะ",
}
REPLIES: dict[str, list[str] | str] = {
    "positive": [
        "ขอบคุณมากเลยนะคะ ดีใจที่ถูกใจสินค้า ฝากกดติดตามร้านและรอโปรโมชั่นดี ๆ ครั้งหน้าด้วยนะคะ",
        "ขอบคุณสำหรับรีวิวดี ๆ นะคะ เป็นกำลังใจให้ทีมงานมากเลยค่ะ แล้วกลับมาอุดหนุนกันใหม่นะคะ",
        "ขอบคุณที่ไว้วางใจเลือกซื้อสินค้าของเรานะคะ หากต้องการคำแนะนำเพิ่มเติมทักแชทมาได้ตลอดเลยค่ะ",
        "ดีใจที่ลูกค้าพอใจค่ะ ขอบคุณที่สละเวลารีวิวนะคะ ฝากบอกต่อเพื่อน ๆ และติดตามร้านไว้ด้วยนะคะ",
    ],
    "neutral": "ขอบคุณสำหรับความคิดเห็นนะคะ หากมีข้อสงสัยหรืออยากให้ช่วยเหลือเพิ่มเติม ทักแชทเข้ามาได้เลยค่ะ ทางร้านยินดีดูแลค่ะ",
    "hard": "ขออภัยอย่างสูงค่ะ ทางร้านขอตรวจสอบเรื่องนี้อย่างเร่งด่วน รบกวนทักแชทมาพร้อมเลขออเดอร์ เราจะรีบดูแลและหาทางแก้ไขให้เร็วที่สุดค่ะ",
    "negative": "ขออภัยในความไม่สะดวกด้วยนะคะ รบกวนแจ้งรายละเอียดและเลขออเดอร์มาทางแชท ทางร้านจะรีบตรวจสอบและดูแลให้ค่ะ",
}


@dataclass(frozen=True)
class Lexicon:
    """The words that the rules go by; the defaults are Thai and English."""

    positive: list[str] = field(default_factory=lambda: POSITIVE_WORDS)
    negative: list[str] = field(default_factory=lambda: NEGATIVE_WORDS)
    negation: str = NEGATION
    categories: dict[str, list[str]] = field(default_factory=lambda: CATEGORY_WORDS)
    danger: list[str] = field(default_factory=lambda: DANGER_WORDS)
    warning: list[str] = field(default_factory=lambda: WARNING_WORDS)
    known: list[str] = field(default_factory=lambda: KNOWN_CATEGORIES)
    other: str = OTHER
    praise: str = PRAISE


THAI = Lexicon()


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w.lower()) for w in words], F.lit(False))


def votes(has: Callable[[str], Column], rating: Column, lexicon: Lexicon = THAI) -> Column:
    """Sum of moods: a word counts once, the other way round after the negation; stars weigh in.

    ``has`` tells whether a word occurs; the negation is looked for only where its word does.
    """
    turned = lambda w, sign: F.when(has(lexicon.negation + w), -sign).otherwise(sign)
    vote = lambda w, sign: F.when(has(w), turned(w, sign)).otherwise(0)
    words = _total([vote(w, 1) for w in lexicon.positive] + [vote(w, -1) for w in lexicon.negative])
    return words + F.when(rating >= 4, 1).when(rating <= 2, -2).otherwise(0)


def mood(total: Column) -> Column:
    return F.when(total > 0, "positive").when(total < 0, "negative").otherwise("neutral")


def sentiment(has: Callable[[str], Column], rating: Column, lexicon: Lexicon = THAI) -> Column:
    """positive, negative or neutral, by the sum of ``votes``."""
    return mood(votes(has, rating, lexicon))


def category_hits(has: Callable[[str], Column], lexicon: Lexicon = THAI) -> Column:
    """How many words of each category occur, in the order of the categories."""
    return F.array(*(_total([F.when(has(w), 1).otherwise(0) for w in words]) for words in lexicon.categories.values()))


def category(hits: Column, lexicon: Lexicon = THAI) -> Column:
    """The category with most hits, the first of equals; null without a hit."""
    names = F.array(*map(F.lit, lexicon.categories))
    return F.when(F.array_max(hits) > 0, F.element_at(names, F.array_position(hits, F.array_max(hits)).cast("int")))


def label_comments(comments: DataFrame, lexicon: Lexicon = THAI, labels: DataFrame | None = None) -> DataFrame:
    """Adds sentiment, category, severity, summary, suggested_action, urgent and analyzed_by.

    ``labels`` (comment_id, sentiment, category, severity, summary, suggested_action, urgent) holds labels from
    elsewhere; where a comment has one it stands in for the rules. Dangerous words, low stars and severity raise
    urgency; high stars, or a positive text without stars, take it back. ``comments`` has comment_id, comment, rating.
    """
    text = F.coalesce("comment", F.lit(""))
    rated = F.when(~F.isnan(F.col("rating").cast("double")), F.col("rating").cast("double"))
    occurs = lambda w: F.col("_lowered").contains(w)
    some = lambda alarms: reduce(lambda a, b: a | b, [occurs(w.lower()) for w in alarms], F.lit(False))
    rows = comments.withColumn("_text", text).withColumn("_rating", rated).withColumn("_lowered", F.lower("_text"))
    # Rows of a generator: a filter by a label can't be moved below it, where each word it asks for would lower the text anew.
    signs = F.struct(votes(occurs, F.col("_rating"), lexicon).alias("_votes"), category_hits(occurs, lexicon).alias("_of"), some(lexicon.danger).alias("_hard"), some(lexicon.warning).alias("_soft"))
    rows = rows.select("*", F.inline(F.array(signs))).withColumn("_mood", mood(F.col("_votes")))
    guess = F.when(F.col("_mood") == "positive", lexicon.praise).otherwise(F.coalesce(category(F.col("_of"), lexicon), F.lit(lexicon.other)))
    if labels is None:
        rows = rows.withColumns({"_l": F.lit(None).cast("string"), "_c": guess, "_sev": F.when(F.col("_mood") == "negative", 6).otherwise(0), "_sum": F.substring("_text", 1, 80), "_act": F.lit(""), "_urg": F.lit(False)})
    else:
        given = labels.select(F.col("comment_id"), F.coalesce("sentiment", F.lit("neutral")).alias("_l"), F.col("category").alias("_lc"), F.coalesce(F.col("severity").cast("int"), F.lit(0)).alias("_ls"), F.coalesce("summary", F.lit("")).alias("_lsum"), F.coalesce("suggested_action", F.lit("")).alias("_lact"), F.coalesce("urgent", F.lit(False)).alias("_lu"))
        has = F.col("_l").isNotNull()
        rows = rows.join(given, "comment_id", "left").withColumns(
            {
                "_c": F.when(has, F.col("_lc")).otherwise(guess),
                "_sev": F.when(has, F.col("_ls")).when(F.col("_mood") == "negative", 6).otherwise(0),
                "_sum": F.when(has, F.col("_lsum")).otherwise(F.substring("_text", 1, 80)),
                "_act": F.when(has, F.col("_lact")).otherwise(""),
                "_urg": F.when(has, F.col("_lu")).otherwise(False),
            }
        )
    rows = rows.withColumns({"_low": F.coalesce(F.col("_rating") <= 2, F.lit(False)), "sentiment": F.coalesce("_l", "_mood")})
    raised = F.greatest("_sev", F.when(F.col("_hard"), 9).when(F.col("_soft"), 8).otherwise(0), F.when(F.col("_low"), 7).otherwise(0))
    rows = rows.withColumn("_raised", raised)
    urgent = F.col("_urg") | F.col("_hard") | F.col("_soft") | F.col("_low") | (F.col("_raised") >= 7)
    calm = F.coalesce(F.col("_rating") >= 4, F.lit(False)) | (F.col("_rating").isNull() & (F.col("sentiment") == "positive"))
    rows = rows.withColumn("_alarm", urgent)
    released = F.col("_alarm") & calm
    out = rows.withColumns(
        {
            "category": F.when(F.col("_c").isin(lexicon.known), F.col("_c")).otherwise(lexicon.other),
            "severity": F.when(released, F.least("_raised", F.lit(4))).otherwise(F.col("_raised")).cast("int"),
            "urgent": F.col("_alarm") & ~calm,
            "summary": F.substring("_sum", 1, 120),
            "suggested_action": F.substring("_act", 1, 300),
            "analyzed_by": F.when(F.col("_l").isNotNull(), "ai").otherwise("rule"),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def parse_label_json(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Rows of a labelling reply: fences are stripped, else the first {...} block is read; one row for each result."""
    body = F.regexp_replace(F.trim(column), r"^```(?:json)?\s*|\s*```$", "")
    block = F.when(body.startswith("{"), body).otherwise(F.regexp_extract(column, r"(?s)(\{.*\})", 1))
    kind = "struct<results:array<struct<index:int,sentiment:string,category:string,severity:double,summary:string,suggested_action:string,urgent:boolean>>>"
    rest = [c for c in replies.columns if c != column]
    return replies.select(*rest, F.explode(F.from_json(block, kind)["results"]).alias("r")).select(*rest, "r.*")


def direction(score: Column) -> Column:
    """A word for a sentiment score."""
    return F.when(score >= 40, "ดีมาก").when(score >= 15, "ค่อนข้างดี").when(score > -15, "ทรงตัว/ผสม").when(score > -40, "ค่อนข้างแย่").otherwise("แย่ ต้องรีบแก้")


def seed_index(seed: Column, choices: int) -> Column:
    """A stable choice from an id: h = 31 h + code point, modulo 2**32; the first for a null or empty id."""
    step = lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32))
    h = F.aggregate(F.filter(F.split(F.coalesce(seed, F.lit("")), ""), lambda c: c != ""), F.lit(0).cast("long"), step)
    return F.pmod(h, F.lit(choices)).cast("int")


def suggest_reply(rows: DataFrame, templates: dict[str, list[str] | str] = REPLIES, by_category: dict[str, str] = CATEGORY_REPLIES, other: str = OTHER) -> DataFrame:
    """Adds reply: templates has positive (a list), neutral, hard and negative; by_category has one for each category."""
    positive = F.element_at(F.array(*map(F.lit, templates["positive"])), seed_index(F.col("comment_id").cast("string"), len(templates["positive"])) + 1)
    out = F.when(F.col("sentiment") == "positive", positive).when(F.col("urgent") & (F.coalesce("category", F.lit(other)) == other), templates["hard"])
    for c, text in by_category.items():
        out = out.when(F.col("category") == c, text)
    out = out.when((F.col("sentiment") == "neutral") & ~F.coalesce("urgent", F.lit(False)), templates["neutral"])
    return rows.withColumn("reply", out.when(F.col("urgent"), templates["hard"]).otherwise(templates["negative"]))


def product_kind(name: Column, brand: Column, words: dict[str, list[str]] = PRODUCT_WORDS) -> Column:
    """The first kind of product of which a keyword occurs in name or brand, else generic."""
    t = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(brand, F.lit(""))))
    out = F.when(F.trim(t) == "", "generic")
    for kind, kw in words.items():
        out = out.when(_any(t, kw), kind)
    return out.otherwise("generic")


def weather_factors(kind: Column) -> Column:
    """The weather columns that may bear on a kind of product."""
    out = None
    for k, factors in WEATHER_FACTORS.items():
        value = F.array(*map(F.lit, factors)).cast("array<string>")
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out.otherwise(F.array().cast("array<string>"))
