"""Operator 7: information-theoretic sanitisation of personal data, DataFrame functions only.

Protected entities are the values of base spans (e-mail addresses, IP addresses, card and phone numbers). Words within
REACH code points of an entity's mentions co-occur with it. With n_ct distinct contexts that hold entity c and term t, n_c
contexts of c, n_t occurrences of t in the whole corpus and N words in all, t discloses c by PMI(c; t) / IC(c) =
log(p(c|t) / p(c)) / -log p(c), where p(c) = n_c / N and p(c|t) is the lower bound of n_ct / n_t (Wilson's, ERRORS standard
errors): near 1 if t is seen nowhere but next to c. The bound tempers low counts, so a frequent word near an entity by chance
does not pass, and an entity that is mentioned once has terms like any other. Terms at or above THRESHOLD are replaced like
the entities themselves, wherever they stand. Equal contexts count once, so copies of one passage are one piece of evidence.
Any word with a letter or digit can be a term.

The base patterns are the contract's, made safe for very long runs by possessive repeats and by starting only at the begin
of a run (or where the last match ended), which finds the same matches. Offsets are running sums in log n sweeps over an
array, so a text of many matches costs little more than its length. Texts meet their terms by content, not by id.

Defined cases: null and empty texts have no spans; repeated rows and null ids give results like other rows; where spans
overlap, all are reported, and in the sanitised text the first one's mark stands for the overlapping run; term spans that
overlap base spans are left out; empty tables give no rows; extra columns are kept by :func:`find_spans`, except those named
pii_text, pii_base or pii_terms, which give way to its own, and by :func:`sanitise` without exception; the query ignores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, bitmap_of, bitmap_words, bounded, in_bitmap, lower_az, materialise, table

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for a kind to be searched.
NEEDS = {"email": "@", "phone": "+"}
REACH, ERRORS, THRESHOLD = 80, 1.64, 0.8
BROADCAST_TERMS = 100_000
#: Bits of a word that are looked up before it becomes a row.
PROBES = 3
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: The edges of all words of a text that have a letter or digit.
_S, _P, _LN = r"\x20\x09-\x0D", r"[^\p{L}\p{N}\x20\x09-\x0D]", r"[\p{L}\p{N}]"
_ALL_EDGES = rf"(?<![^{_S}]){_P}++(?={_LN})|(?<={_LN}){_P}++(?![^{_S}])"
#: Code points of the pieces that a text is cut in to reach any place of it.
PIECE = 4096
_PIECES = rf"(?s).{{1,{PIECE}}}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    back = F.reverse(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: back.substr(i, F.lit(1)).cast("int") * (F.lit(2) - i % 2),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def held(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(values: Column, op) -> Column:
    """Running results of an associative op over an array (held already), in about log2(n) sweeps."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(values))
    return F.aggregate(steps, values, lambda acc, s: F.transform(acc, lambda x, i: F.when(i < s, x).otherwise(op(F.get(acc, i - s), x))))


def _ends(pieces: Column, gaps: Column) -> Column:
    """Where each piece ends in a text that alternates gaps (one more) and pieces."""
    lengths = F.zip_with(pieces, F.slice(gaps, 1, F.size(pieces)), lambda m, g: (F.length(m) + F.length(g)).cast("bigint"))
    return held(lengths, lambda x: scan(x, lambda a, b: a + b))


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<m, start>>; start counts code points from 0."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"), F.split(text, pattern, -1).alias("gaps"))
    return held(both, lambda b: F.zip_with(b["ms"], _ends(b["ms"], b["gaps"]), lambda m, e: F.struct(m.alias("m"), (e - F.length(m)).alias("start"))))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of valid base spans, by kind, then start."""
    none = F.array().cast(SPAN)
    parts = []

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(
            F.filter(found(text, pattern), lambda x: _valid(kind, x["m"])),
            lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("value")),
        ).cast(SPAN)

    for kind, pattern in PATTERNS.items():
        needed = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9][0-9. -]*[0-9]")
        parts.append(F.when(needed, of_kind(kind, pattern)).otherwise(none))
    return F.concat(*parts)


def bare_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and without what is no letter or digit at their edges; words of neither stay."""
    return F.filter(F.split(F.regexp_replace(lower_az(text), _ALL_EDGES, ""), SPACE), lambda w: w != "")


def _terms(window: Column) -> Column:
    return F.array_distinct(F.filter(bare_words(window), lambda w: w.rlike(_LN)))


def filter_of(terms: DataFrame):
    """A test of words that all terms of a table (term) pass and, up to 65,000 terms, fewer than 1 in 1000 of the others; beyond, more pass and are dropped by the join."""
    size = bitmap_words(terms.count())
    bitmap = bitmap_of(terms.select(F.xxhash64("term").alias("h")), size, PROBES)
    return lambda w: in_bitmap(bitmap, F.xxhash64(w), size, PROBES)


def disclosing_terms(marked: DataFrame, text: str, spans: str, *, errors: float = ERRORS, threshold: float = THRESHOLD) -> DataFrame:
    """(term, disclosure): the terms whose disclosure of some entity reaches the threshold; read from all texts."""
    # windows are cut before mentions become rows, so a row holds its window alone
    both = F.struct(F.regexp_extract_all(F.col(text), F.lit(_PIECES), F.lit(0)).alias("pieces"), F.length(text).cast("bigint").alias("n"))

    def window(b: Column, s: Column) -> Column:
        left = part_of(b["pieces"], F.greatest(s["start"] - REACH, F.lit(0)), F.least(s["start"], F.lit(REACH)))
        right = part_of(b["pieces"], s["end"], F.least(b["n"] - s["end"], F.lit(REACH)))
        # words cut by the window's edge are no terms
        left = F.when(s["start"] > REACH, F.regexp_replace(left, rf"^{WORD}", "")).otherwise(left)
        right = F.when(b["n"] > s["end"] + REACH, F.regexp_replace(right, rf"{WORD}$", "")).otherwise(right)
        return F.struct(F.xxhash64(s["kind"], F.lower(s["value"])).alias("entity"), left.alias("left"), right.alias("right"))

    windows = held(both, lambda b: F.transform(F.col(spans), lambda s: window(b, s)))
    mentions = marked.where(F.size(spans) > 0).select(F.explode(windows).alias("w")).select("w.*")
    near = mentions.select("entity", F.xxhash64("left", "right").alias("context"), _terms(F.concat("left", F.lit(" "), "right")).alias("terms")).distinct()
    near = materialise(near, "mentions")
    entities = near.groupBy("entity").agg(F.countDistinct("context").alias("n_c"))
    pairs = near.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.countDistinct("context").alias("n_ct"))
    pairs = materialise(pairs.join(entities, "entity"), "pairs")
    if pairs.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("disclosure"))
    wanted = materialise(pairs.select("term").distinct(), "terms")
    # most words are wanted here, so one look is enough
    bitmap = bitmap_of(wanted.select(F.xxhash64("term").alias("h")))
    words = marked.select(F.explode_outer(F.filter(bare_words(F.col(text)), lambda w: in_bitmap(bitmap, F.xxhash64(w)))).alias("term")).where("term <> ''")
    n_t = F.count("*").alias("n_t")
    if bounded(wanted, BROADCAST_TERMS):
        counted = words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(n_t)
    else:  # counts are shuffled, not words
        counted = words.groupBy("term").agg(n_t).join(wanted, "term", "left_semi")
    total = marked.agg(F.sum(F.regexp_count(F.col(text), F.lit(WORD)))).first()[0] or 0
    rate = F.col("n_c") / F.lit(float(max(total, 2)))
    n_t, square = F.greatest("n_t", "n_ct").cast("double"), errors**2
    seen = F.col("n_ct") / n_t
    sure = (seen + square / (2 * n_t) - errors * F.sqrt(seen * (1 - seen) / n_t + square / (4 * n_t * n_t))) / (1 + square / n_t)
    # an entity as common as all words together has no information to disclose
    ratio = F.when(rate < 1, F.log(sure / rate) / -F.log(rate))
    joined = pairs.join(counted, "term").select("term", ratio.alias("disclosure")).where(F.col("disclosure") >= threshold)
    return materialise(joined.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosing")


def term_spans(text: Column, hits: Column, base: Column) -> Column:
    """Spans of the words at the places `hits` (counted from 0), less what is no letter or digit at their edges, outside base spans."""
    both = F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("ms"), F.split(text, WORD, -1).alias("gaps"), hits.alias("hits"), base.alias("base"))

    def span_of(b: Column, ends: Column, place: Column) -> Column:
        word = F.get(b["ms"], place)
        bare = F.regexp_replace(word, _EDGES, "")
        start = F.get(ends, place) - F.length(F.regexp_replace(word, r"^[^\p{L}\p{N}]+", ""))
        return F.struct(start.alias("start"), F.lit(1).alias("term"), (start + F.length(bare)).alias("end"), bare.alias("value"))

    def outside(spans: Column) -> Column:
        """Of spans in order of start, base ones before terms, the terms that no base span overlaps."""
        none = F.lit(1 << 62)
        upto = held(F.transform(spans, lambda x: F.when(x["term"] == 0, x["end"]).otherwise(F.lit(0).cast("bigint"))), lambda x: scan(x, F.greatest))
        after = held(F.reverse(F.transform(spans, lambda x: F.when(x["term"] == 0, x["start"]).otherwise(none))), lambda x: F.reverse(scan(x, F.least)))
        about = F.arrays_zip(spans.alias("s"), upto.alias("upto"), after.alias("after"))
        free = F.filter(about, lambda x: (x["s"]["term"] == 1) & (x["upto"] <= x["s"]["start"]) & (x["after"] >= x["s"]["end"]))
        return F.transform(free, lambda x: F.struct(F.lit("term").alias("kind"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["value"].alias("value"))).cast(SPAN)

    def one(b: Column) -> Column:
        terms = held(_ends(b["ms"], b["gaps"]), lambda ends: F.transform(b["hits"], lambda p: span_of(b, ends, p)))
        others = F.transform(b["base"], lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("term"), x["end"].alias("end"), x["value"].alias("value")))
        return held(F.array_sort(F.concat(others, terms)), outside)

    return held(both, one)


def _spans(docs: DataFrame, text_col: str, **options) -> DataFrame:
    """(row, pii_text, pii_base, pii_terms) of all rows of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("pii_text"))
    marked = rows.withColumn("pii_base", base_spans(F.col("pii_text")))
    terms = disclosing_terms(marked.select("pii_text", "pii_base"), "pii_text", "pii_base", **options)
    none = F.array().cast(SPAN)
    if terms.isEmpty():
        return marked.withColumn("pii_terms", none)
    terms = terms.select("term")
    hint = F.broadcast if bounded(terms, BROADCAST_TERMS) else (lambda df: df)
    likely = filter_of(terms)
    # 96 bits of a text's content stand for it: copies share their hits, and rows need no id
    key = [F.xxhash64("pii_text").alias("h1"), F.hash("pii_text").alias("h2")]
    near = F.transform(bare_words(F.col("pii_text")), lambda w, i: F.when(likely(w), F.struct(i.alias("place"), w.alias("term"))))
    words = rows.select(*key, F.explode_outer(F.filter(near, lambda x: x.isNotNull())).alias("x")).where("x IS NOT NULL").select("h1", "h2", "x.place", "x.term")
    hits = words.join(hint(terms), "term", "left_semi").groupBy("h1", "h2").agg(F.sort_array(F.collect_set("place")).alias("pii_hits"))
    hits = materialise(hits, "hits")
    near = F.broadcast(hits) if bounded(hits, BROADCAST_TERMS) else hits
    joined = marked.join(near, (F.xxhash64("pii_text") == F.col("h1")) & (F.hash("pii_text") == F.col("h2")), "left")
    spans = F.when(F.col("pii_hits").isNotNull(), term_spans(F.col("pii_text"), F.col("pii_hits"), F.col("pii_base"))).otherwise(none)
    return joined.select("row", "pii_text", "pii_base", spans.alias("pii_terms"))


def find_spans(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """All rows of docs with pii_text (never null), pii_base and pii_terms (arrays of spans)."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("pii_text", "pii_base", "pii_terms")]
    return _spans(docs, text_col, **options).select(*kept, "pii_text", "pii_base", "pii_terms")


def part_of(pieces: Column, at: Column, n: Column) -> Column:
    """n code points from `at` (from 0) of a text cut into pieces of PIECE code points."""
    i, j = F.floor(at / PIECE).cast("int"), F.floor((at + n) / PIECE).cast("int")
    begin, stop = (at % PIECE).cast("int"), ((at + n) % PIECE).cast("int")
    head = F.get(pieces, i).substr(begin + 1, F.lit(PIECE))
    last = F.coalesce(F.get(pieces, j).substr(F.lit(1), stop), F.lit(""))
    over = F.concat(head, F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), last)
    return F.when(n <= 0, F.lit("")).when(i == j, F.get(pieces, i).substr(begin + 1, n.cast("int"))).otherwise(over)


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mark such as <EMAIL>."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    both = F.struct(ordered.alias("spans"), F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)).alias("pieces"), F.length(text).cast("bigint").alias("n"))

    def marks(b: Column, ends: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint"))
            mark = F.concat(part_of(b["pieces"], before, s["start"] - before), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.when(s["start"] >= before, mark).otherwise(F.lit(""))

        rest = held(F.element_at(ends, -1), lambda at: part_of(b["pieces"], at, b["n"] - at))
        return F.array_join(F.concat(F.transform(b["spans"], one), F.array(rest)), "")

    ends = lambda b: held(F.transform(b["spans"], lambda s: s["end"]), lambda x: scan(x, F.greatest))
    return F.when(F.size(spans) == 0, text).otherwise(held(both, lambda b: held(ends(b), lambda e: marks(b, e))))


def sanitise(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """docs with personal data and disclosing terms replaced in the text column; columns as in docs."""
    new = F.when(F.col(f"row.`{text_col}`").isNotNull(), replaced(F.col("pii_text"), F.concat("pii_base", "pii_terms")))
    return _spans(docs, text_col, **options).select(*[(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return spans.select("doc_id", *[number(k) for k in PATTERNS], F.sha2(said(F.col("pii_base")), 256).alias("base_sha256"), said(F.concat("pii_base", "pii_terms")).alias("spans"))
