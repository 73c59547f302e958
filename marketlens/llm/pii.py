"""Personal data: base patterns, and contextual extraction bootstrapped from what they find. DataFrame functions only.

Base spans come from four patterns with checks on digits. Java's matcher finds matches leftmost and without overlap in
both split() and regexp_extract_all(), so the lengths of gaps and hits give each match's place in code points. The
patterns are anchored so that a run of characters is tried once, which keeps long texts linear.

Bootstrapping: the seeds are the base spans, and of secrets the values of any key (``key = value``) that look random: ``RANDOM``
characters or more, letters and digits mixed, a change from one to the other at every fourth character at least. No list
of key names is used. Tokens with a digit or an @, and runs of digit groups, that are no seed are the candidates. An
occurrence has patterns: the word before, the word after, the key it is the value of, its shape (digits, lower and upper
case letters each as one sign, in full and with runs as one), for mixed letters and digits how often they change and the
size of the length, and for values with an @ the shape, the last two labels and the last label of the domain. Spark
scores the graph of patterns and instances in rounds. A pattern's confidence in a kind is

    known / (known + known of other kinds + DOUBT * unknown + 1)

in distinct values; from ``SUPPORT`` known values and a confidence of ``PRECISION`` on it counts. The belief that a candidate is
of a kind that its own characters allow is 1 - product(1 - confidence) over its patterns; from ``ACCEPT`` on it is accepted,
so one pattern seldom suffices, and known in the next round. As unknown count the candidates alone that the kind allows, each
less what is believed of it already. So beliefs grow from round to round; rounds end when none is accepted and the
beliefs have grown by less than ``SETTLED`` in all. Base spans always stay. The kinds found are the four of the
base, and ``secret``, which stands last where spans begin together.

A null text counts as empty. Rows that repeat repeat in the result. Empty tables give empty results; other columns are
kept by ``redacted`` and ignored by ``spans``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import aside, parted, written

KINDS = ["email", "ip", "card", "phone"]
SECRET = "secret"
RANDOM = 20  # characters of a random-looking value that is a seed
SUPPORT, PRECISION, DOUBT, ACCEPT, SETTLED = 5, 0.7, 0.25, 0.9, 0.01

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
GROUPS = r"(?<![\p{L}\p{N}])[+(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)++"  # digits in several groups
KEY = r"([\p{L}_][\p{L}\p{N}_.-]*)\s*[=:]\s*[\"'(\[{<]?$"  # what stands before the value of a key
_CONTEXT = 48  # characters in which a neighbouring word is looked for

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's variable holds it, through an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(array: Column, start: Column, n: Column) -> Column:
    return F.aggregate(F.slice(array, start, n), F.lit(0), lambda s, x: s + x)


def _found(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit) of all matches, in code points, end exclusive.

    A match starts after the gaps and hits before it and its own gap; their lengths are summed by blocks of 64 and of
    4096, so that a hit costs a few sums however many there are.
    """

    def steps(a: Column) -> Column:
        return F.struct(a["gaps"].alias("gaps"), a["hits"].alias("hits"), F.transform(a["hits"], lambda h, i: a["gaps"][i] + F.length(h)).alias("steps"))

    def by_64(array: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(array) / 64).cast("int")), lambda j: _sum(array, j * 64 + 1, F.lit(64)))

    def blocks(b: Column) -> Column:
        return F.struct(b["gaps"].alias("gaps"), b["hits"].alias("hits"), b["steps"].alias("steps"), by_64(b["steps"]).alias("sums"))

    def more(b: Column) -> Column:
        return F.struct(b["gaps"].alias("gaps"), b["hits"].alias("hits"), b["steps"].alias("steps"), b["sums"].alias("sums"), by_64(b["sums"]).alias("supers"))

    def place(c: Column, hit: Column, i: Column) -> Column:
        k, j = F.floor(i / 64).cast("int"), F.floor(i / 4096).cast("int")
        start = _sum(c["supers"], F.lit(1), j) + _sum(c["sums"], j * 64 + 1, k % 64) + _sum(c["steps"], k * 64 + 1, i % 64) + c["gaps"][i]
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"))

    found = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"))
    return _let(found, lambda a: _let(steps(a), lambda b: _let(blocks(b), lambda c: _let(more(c), lambda d: F.transform(d["hits"], lambda hit, i: place(d, hit, i))))))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(hit: Column) -> Column:
    def small(p: Column) -> Column:
        p = F.ltrim(p, F.lit("0"))
        return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))

    return F.forall(F.split(hit, r"\."), small)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    card = lambda h: F.replace(F.replace(h, F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    digits = lambda h: F.length(F.regexp_replace(h, "[^0-9]", ""))
    some = text.rlike("[0-9]")
    rules = [
        (EMAIL, F.contains(text, F.lit("@")), lambda h: F.lit(True)),
        (IP, some, _octets),
        (CARD, some, lambda h: F.when(F.length(card(h)).between(14, 19), _luhn(card(h))).otherwise(False)),
        (PHONE, F.contains(text, F.lit("+")), lambda h: digits(h).between(10, 15)),
    ]
    none = F.array().cast(SPAN)

    def of(rank: int, pattern: str, valid: Callable[[Column], Column]) -> Column:
        good = F.filter(_found(text, pattern), lambda m: valid(m["hit"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(KINDS[rank]).alias("kind")))

    parts = [F.when(possible, of(rank, pattern, valid)).otherwise(none) for rank, (pattern, possible, valid) in enumerate(rules)]
    return F.array_sort(F.concat(*parts))


def _word(text: Column, last: bool) -> Column:
    """The last or first word of a short text, lower-cased, without punctuation; null where there is none."""
    word = F.regexp_extract(text, r"(\S+)\s*$" if last else r"^\s*(\S+)", 1)
    word = F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")
    return F.when(word == "", None).otherwise(word)


def _shape(value: Column) -> Column:
    """Digits, lower and upper case letters each as one sign."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Lu}", "A"), r"(?!A)\p{L}", "a"), r"\p{Nd}", "9")


def _patterns(text: Column, start: Column, end: Column, value: Column) -> Column:
    """The patterns of an occurrence, null where there is none of a sort."""
    before = F.substring(text, F.greatest(start - _CONTEXT + 1, F.lit(1)), F.least(start, F.lit(_CONTEXT)))
    after = F.substring(text, end + 1, F.lit(_CONTEXT))
    key = F.regexp_extract(before, KEY, 1)

    def of(z: Column) -> Column:
        mixed = F.when(z["short"].rlike("^[Aa9]*$") & z["short"].contains("9") & z["short"].rlike("[Aa]"), F.length(z["short"]))
        return F.array(
            F.concat(F.lit("before "), _word(before, True)),
            F.concat(F.lit("after "), _word(after, False)),
            F.concat(F.lit("key "), F.nullif(F.lower(key), F.lit(""))),
            F.concat(F.lit("shape "), z["full"]),
            F.concat(F.lit("runs "), z["short"]),
            F.when(mixed >= 4, F.lit("mixed")),
            F.concat(F.lit("mixed "), F.floor(F.log2(F.when(mixed >= 4, F.length(value)))).cast("string")),
            F.concat(F.lit("domain shape "), F.nullif(F.regexp_extract(z["short"], "@([^@]+)$", 1), F.lit(""))),
            F.concat(F.lit("domain "), F.nullif(F.lower(F.regexp_extract(value, r"@(?:[^@]*\.)?([^@.]+\.[^@.]+)$", 1)), F.lit(""))),
            F.concat(F.lit("domain ends "), F.nullif(F.lower(F.regexp_extract(value, r"@[^@]*\.([^@.]+)$", 1)), F.lit(""))),
        )

    shapes = lambda full: F.struct(full.alias("full"), F.regexp_replace(full, r"(.)\1+", "$1").alias("short"))
    return F.filter(_let(_let(_shape(value), shapes), of), lambda p: p.isNotNull())


def _seen(text: Column, spans: Column) -> Column:
    """(start, end, kind, value, digits, at, mixed, luhn, patterns) of (start, end, kind) spans; kind is null for candidates, but for random-looking values of a key."""

    def one(s: Column) -> Column:
        def of(value: Column) -> Column:
            def named(patterns: Column) -> Column:
                mixed = (F.length(value) >= 8) & value.rlike(r"\p{L}") & value.rlike("[0-9]") & value.rlike(r"^[\p{L}\p{N}_+/=.-]*$")
                digits = F.regexp_replace(value, "[^0-9]", "")
                changes = F.length(F.regexp_replace(_shape(value), r"(.)\1+", "$1"))
                secret = mixed & (F.length(value) >= RANDOM) & F.exists(patterns, lambda p: p.startswith("key ")) & (4 * changes >= F.length(value))
                return F.struct(
                    s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["kind"], F.when(secret, F.lit(SECRET))).alias("kind"), F.xxhash64(value).alias("value"),
                    F.length(digits).alias("digits"), F.contains(value, F.lit("@")).alias("at"), mixed.alias("mixed"), F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False).alias("luhn"), patterns.alias("patterns"),
                )

            return _let(_patterns(text, s["start"], s["end"], value), named)

        return _let(F.substring(text, s["start"] + 1, s["end"] - s["start"]), of)

    return F.transform(spans, one)


def _candidates(text: Column, base: Column) -> Column:
    """Identifier-like tokens and digit groups clear of base spans, without the key and the punctuation around them."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    tokens = F.when(text.rlike("[0-9@]"), _found(text, TOKEN)).otherwise(none)
    groups = F.when(text.rlike(r"[0-9)]\x20[(]?[0-9]"), _found(text, GROUPS)).otherwise(none)

    def trim(m: Column) -> Column:
        def of(z: Column) -> Column:
            lead = F.length(m["hit"]) - F.length(F.regexp_replace(z["inner"], r"^[^\p{L}\p{N}+(]+", ""))
            tail = F.length(z["inner"]) - F.length(F.regexp_replace(z["inner"], r"[^\p{L}\p{N}]+$", ""))
            return F.struct((m["start"] + lead).alias("start"), (m["end"] - tail).alias("end"), F.lit(None).cast("string").alias("kind"))

        # a key and its sign go from the front
        return _let(F.struct(F.regexp_replace(m["hit"], r"^[\p{L}_][\p{L}\p{N}_.-]*[=:](?=.)", "").alias("inner")), of)

    inner = F.filter(F.transform(F.concat(tokens, groups), trim), lambda m: m["start"] < m["end"])
    return F.filter(inner, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))


def _scanned(documents: DataFrame) -> DataFrame:
    """(doc_id, h, base, seen): base spans, and seeds and candidates with their patterns, cut from the texts."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", F.xxhash64("t").alias("h"), base_spans(F.col("t")).alias("base"))
    seeds = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind")))
    seen = _seen(F.col("t"), F.concat(seeds, _candidates(F.col("t"), F.col("base"))))
    return written(rows.select("doc_id", "h", "base", seen.alias("seen")), "pii-scan")


def _allowed() -> dict[str, Column]:
    """By kind, whether a candidate's own characters allow it."""
    n = F.col("digits")
    return {"email": F.col("at"), "ip": n.between(4, 12), "card": F.col("luhn"), "phone": n.between(7, 15), SECRET: F.col("mixed")}


def accepted(edges: DataFrame, support: int = SUPPORT, precision: float = PRECISION, doubt: float = DOUBT, accept: float = ACCEPT) -> DataFrame:
    """(value, kind) of seeds and accepted candidates, from the graph (value, kind, digits, at, mixed, luhn, pattern) of distinct rows.

    A value that is a seed of several kinds keeps the first of them by name.
    """
    known = edges.filter("kind is not null").groupBy("value").agg(F.min("kind").alias("kind"))
    known = written(known, "pii-known")
    links = written(edges.groupBy("value", "pattern").agg(F.max("digits").alias("digits"), F.max("at").alias("at"), F.max("mixed").alias("mixed"), F.max("luhn").alias("luhn")), "pii-links")
    known_of = lambda k: F.count(F.when(F.col("kind") == k, 1))
    open_of = lambda k, allowed: F.sum(F.when(F.col("kind").isNull() & allowed, 1 - F.coalesce(F.col("belief")[k], F.lit(0.0))).otherwise(0.0))
    fits = reduce(lambda w, k: w.when(F.col("as") == k, _allowed()[k]), [*KINDS, SECRET], F.when(F.lit(False), False))
    beliefs, total = links.sparkSession.createDataFrame([], "value long, belief map<string, double>"), 0.0
    while True:
        votes = links.join(known, "value", "left").join(beliefs, "value", "left").groupBy("pattern")
        votes = votes.agg(F.count("kind").alias("all"), F.array(*(F.struct(F.lit(k).alias("as"), known_of(k).alias("n"), open_of(k, ok).alias("open")) for k, ok in _allowed().items())).alias("kinds"))
        good = votes.select("pattern", "all", F.inline("kinds")).filter(F.col("n") >= support)
        good = good.select("pattern", "as", F.round(F.col("n") / (F.col("all") + F.col("open") * doubt + 1), 6).alias("sure")).filter(F.col("sure") >= precision)
        unknown = links.join(known.select("value"), "value", "left_anti")
        scored = unknown.join(good, "pattern").filter(fits).groupBy("value", "as").agg(F.round(F.sum(F.log1p(-F.col("sure"))), 6).alias("against"))
        scored = written(scored.groupBy("value").agg(F.min(F.struct("against", "as")).alias("best"), F.map_from_entries(F.collect_list(F.struct("as", (1 - F.exp("against")).alias("b")))).alias("belief")), "pii-beliefs")
        sure = F.exp("best.against") <= 1 - accept
        grown = scored.filter(~sure).agg(F.sum(F.aggregate(F.map_values("belief"), F.lit(0.0), lambda a, b: a + b))).first()[0] or 0.0
        fresh = scored.filter(sure).select("value", F.col("best.as").alias("kind"))
        if not fresh.head(1) and grown <= total * (1 + SETTLED):
            return known
        known, beliefs, total = written(known.unionByName(fresh), "pii-known"), scored.filter(~sure).select("value", "belief"), grown


def bootstrapped(scan: DataFrame) -> DataFrame:
    """(doc_id, h, start, end, kind) of the seeds of secrets and the candidates that high-confidence patterns give away."""
    graph = scan.select("doc_id", "h", F.explode("seen").alias("s")).select("doc_id", "h", "s.*")
    edges = graph.select("value", "kind", "digits", "at", "mixed", "luhn", F.explode("patterns").alias("pattern")).distinct()
    known = accepted(written(edges, "pii-graph"))
    found = graph.filter(F.col("kind").isNull() | (F.col("kind") == SECRET)).drop("kind").join(known, "value")
    return found.select("doc_id", "h", "start", "end", "kind").distinct()


def _more(extra: DataFrame) -> DataFrame:
    """(_id, _h, more): the extra spans of each text that has any."""
    kinds = [*KINDS, SECRET]
    rank = reduce(lambda w, k: w.when(F.col("kind") == k, kinds.index(k)), kinds, F.when(F.lit(False), 0)).cast("int")
    return extra.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind")).alias("more"))


def _every(base: Column) -> Column:
    return F.array_sort(F.concat(base, F.coalesce(F.col("more").cast(SPAN), F.array().cast(SPAN))))


def _same_text() -> Column:
    return F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, base, all): arrays of (start, rank, end, kind), sorted."""
    scan = _scanned(documents)
    more = written(_more(bootstrapped(scan)), "pii-more")
    return scan.join(more, _same_text(), "left").select("doc_id", "base", _every(F.col("base")).alias("all"))


def count(array: str, kind: str) -> Column:
    return F.size(F.filter(array, lambda s: s["kind"] == kind)).cast("long")


def joined(array: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with every span's text replaced by its kind in brackets; n_chars, where there is one, follows."""
    return aside(documents, _redacted)


def _redacted(documents: DataFrame) -> DataFrame:
    """Base spans are found again in each text, so only texts that may have extra spans are looked up, by id and hash."""
    more = written(_more(bootstrapped(_scanned(documents))), "pii-more")
    columns = documents.columns
    rows = documents.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("_t"))
    some, rest = parted(rows, more.withColumnRenamed("_h", "h"), "h")
    rows = some.join(more, _same_text(), "left").unionByName(rest.withColumns({c: F.lit(None).cast(more.schema[c].dataType) for c in more.columns}))
    rows = rows.withColumn("_all", _every(base_spans(F.col("_t"))))

    def cut(acc: Column, s: Column) -> Column:
        clear = s["start"] >= acc["at"]
        out = F.when(clear, F.concat(acc["out"], F.substring("_t", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate("_all", start, cut, lambda acc: F.concat(acc["out"], F.substring("_t", acc["at"] + 1, F.length("_t"))))
    some = F.size("_all") > 0
    rows = rows.withColumn("text", F.when(some, new).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*columns)
