"""Personal data: fixed patterns, and terms that disclose what they found.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Each
distinct value found is a *protected entity*.  The method then asks which
words give an entity away even after its removal: over the ``N`` distinct texts
of the corpus

* ``n(c)``, ``n(t)``: texts that hold entity c, word t (anywhere);
* ``n(c, t)``: texts that hold c and, outside base spans, t;
* ``disclosure(c, t) = PMI(c; t) / IC(c)`` with
  ``PMI = log(n(c,t) N / (n(c) n(t)))`` and ``IC = log(N / n(c))``: 1 if seeing
  t is as good as seeing c, 0 if t tells nothing of it.

A term with ``n(c, t) >= support`` and disclosure of at least ``remove_at`` is
removed, at every place in each document that holds the entity; from
``generalise_at`` on it is generalised to its shape (``[name]`` for a
capitalised word, ``[word]`` otherwise).  In documents that do not hold the
entity a term to be removed goes too if ``n(c, t) >= elsewhere_support``, so that
chance meetings of a rare word and an entity take no word from other documents;
other terms stay there.  As ``n(c, t) <= n(c)``, a term can reach
``generalise_at`` only with ``n(t) <= N (n(c) / N) ** generalise_at``: pairs beyond
that are dropped before they are counted, and no other.  Base spans stay
whatever the method adds; a term never overlaps one.  Positions count code
points.

All of it is DataFrame functions, and work grows with the length of a text, not
with the square of its matches.  Null and empty texts have no spans.  Ids take no part:
equal texts, whatever their ids, count as one in all of the statistics and get
equal results, so that copies lend no support to the words they share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_spread, let, split_words, text_or_empty

# The kinds in their order, and their patterns.  The possessive
# quantifiers and look-behinds change no match; they keep the search linear.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of the kind holds (no pattern: a digit).
MARKS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A number of at most 255, leading zeros allowed.
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
NOT_LETTERS = r"[^\p{L}]+"
#: Spans that are put back together at a time.
BLOCK = 128
#: The parts each term is dealt to, so that no common term is one task.
SALTS = 8

SPANS = "array<struct<start:int,end:int,value:string>>"
HIDDEN = "array<struct<start:int,end:int,remove:boolean,named:boolean>>"


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``join`` along an array, by doubling: n log n steps."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(30)]), lambda s: s < F.size(values))
    return F.aggregate(steps, values, lambda a, s: F.transform(
        a, lambda x, i: F.when(i >= s, join(x, F.get(a, i - s))).otherwise(x)))


def _places(text: Column, pattern: str, place: Callable[[Column, Column, Column], Column]) -> Column:
    """``place(match, start, end)`` of all leftmost non-overlapping matches."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(b: Column) -> Column:
        sizes = F.transform(b["m"], lambda x, i: F.length(x) + F.length(F.get(b["p"], i)))
        ends = let(sizes, lambda s: _running(s, lambda x, y: x + y))
        return let(ends, lambda e: F.transform(b["m"], lambda x, i: place(x, F.get(e, i) - F.length(x), F.get(e, i))))

    return let(both, placed)


def _all_matches(text: Column, pattern: str) -> Column:
    """The matches with their code-point positions."""
    return _places(text, pattern, lambda m, start, end: F.struct(start.alias("start"), end.alias("end"), m.alias("value"))).cast(SPANS)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(BYTE))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid spans of one kind: array of (start, end, value)."""
    found = F.filter(_all_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    mark = MARKS[kind]
    likely = F.contains(text, F.lit(mark)) if mark else text.rlike("[0-9][\\x20-]?[0-9]")
    return F.when(likely, found).otherwise(F.array().cast(SPANS))


def _masked(text: Column) -> Column:
    """``text`` with its e-mail addresses blanked; every other place stays.

    Base spans of the other kinds hold no letter, so no term either.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)).alias("m"), F.split(text, PATTERNS["email"], -1).alias("p"))
    blanked = let(both, lambda b: F.array_join(F.transform(b["p"], lambda x, i: F.concat(
        x, F.repeat(F.lit(" "), F.coalesce(F.length(F.get(b["m"], i)), F.lit(0))))), ""))
    return F.when(F.contains(text, F.lit("@")), blanked).otherwise(text)


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _terms(text: Column) -> Column:
    """The distinct words of ``text``, hashed."""
    return F.array_distinct(F.transform(split_words(text, NOT_LETTERS), _term))


def _hidden(text: Column, removed: Column, softened: Column) -> Column:
    """Every place of the terms: array of (start, end, remove, named)."""
    words = _places(text, r"\p{L}+", lambda m, start, end: F.struct(
        start.alias("start"), end.alias("end"), _term(m).alias("term"), m.rlike(r"^\p{Lu}").alias("named")))
    known = F.filter(words, lambda w: F.array_contains(removed, w["term"]) | F.array_contains(softened, w["term"]))
    return F.transform(known, lambda w: F.struct(
        w["start"].alias("start"), w["end"].alias("end"), F.array_contains(removed, w["term"]).alias("remove"), w["named"].alias("named"))).cast(HIDDEN)


def _doc(text_col: str) -> Column:
    """The key of a text: equal texts share it."""
    return F.xxhash64(text_or_empty(text_col))


def find_base(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _doc, base (all spans by kind, then start) and masked, for every row.

    ``_doc`` is the hash of the text and stands for it from here on.

    ``masked`` is the text without base spans, null where it has none.
    """
    text = F.col("_text")

    def with_kind(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    typed = [with_kind(k) for k in KINDS]
    found = df.select(F.col(id_col).alias("_id"), _doc(text_col).alias("_doc"),
                      text_or_empty(text_col).alias("_text"))
    found = found.select("_id", "_doc", "_text", *[base_spans(text, k).alias(f"_{k}") for k in KINDS])
    return (
        found.select("_id", "_doc", let(F.concat(*typed), lambda base: F.struct(
            base.alias("base"), F.when(F.size(base) > 0, _masked(text)).alias("masked"))).alias("r"))
        .select("_id", "_doc", "r.base", "r.masked")
    )


def entity_terms(once: DataFrame, docs: DataFrame, total: int, support: int, generalise_at: float) -> DataFrame:
    """(_doc, entity, term, n_c, n_t) of all pairs of a text that may disclose.

    ``docs`` has _doc, entities and masked of each distinct text with base
    spans, ``once`` the _text of every distinct text.
    """
    holds = docs.select("_doc", F.explode("entities").alias("entity"))
    n_c = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")).filter((F.col("n_c") >= support) & (F.col("n_c") < total))
    most = F.lit(total * (1 + 1e-9)) * F.pow(F.col("n_c") / F.lit(float(total)), F.lit(generalise_at))
    sizes = durable(n_c.withColumn("_n", F.col("n_c")))
    met = join_spread(holds, sizes.drop("_n"), ["entity"], "_doc", sizes.select("entity", "_n"))
    held = durable(met.groupBy("_doc").agg(
        F.collect_list(F.struct("entity", "n_c", most.alias("most"))).alias("held"), F.max(most).alias("top")))
    salt = F.pmod(F.col("_doc"), F.lit(SALTS)).cast("int")
    near = docs.join(held, "_doc").select("_doc", "held", "top", salt.alias("salt"), F.explode(_terms(F.col("masked"))).alias("term"))
    n_t = once.select(F.explode(_terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    top = held.agg(F.max("top")).first()[0]
    n_t = durable(n_t.filter((F.col("n_t") >= support) & (F.col("n_t") <= (top or 0.0))))
    n_t = n_t.select("term", "n_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = near.join(n_t, ["term", "salt"]).filter("n_t <= top").select("_doc", "term", "n_t", F.explode("held").alias("e"))
    return pairs.filter("n_t <= e.most").select("_doc", "e.entity", "term", "e.n_c", "n_t")


def disclosing_terms(pairs: DataFrame, total: int, support: int, generalise_at: float) -> DataFrame:
    """(entity, term, disclosure, n_ct) of the pairs at or over ``generalise_at``."""
    n_ct = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct"), F.max("n_t").alias("n_t"), F.max("n_c").alias("n_c"))
    all_of = F.lit(float(total))
    score = F.log(F.col("n_ct") * all_of / (F.col("n_c") * F.col("n_t"))) / F.log(all_of / F.col("n_c"))
    return (
        n_ct.filter(F.col("n_ct") >= support)
        .select("entity", "term", F.least(F.lit(1.0), score).alias("disclosure"), "n_ct")
        .filter(F.col("disclosure") >= generalise_at)
    )


def detect(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: int = 2,
    generalise_at: float = 0.8,
    remove_at: float = 0.95,
    elsewhere_support: int = 20,
) -> DataFrame:
    """Per row: _id, _doc, base spans and the terms to hide.

    ``base`` is an array of (kind, start, end, value); ``hidden`` an array of
    (start, end, remove, named) in order of start.
    """
    found = durable(find_base(df, id_col, text_col).withColumn("_at", F.monotonically_increasing_id()))
    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], s["value"])))
    docs = durable(found.filter("masked is not null").select("_doc", entities.alias("entities"), "masked").dropDuplicates(["_doc"]))
    copies = durable(found.groupBy("_doc").agg(F.count(F.lit(1)).alias("_n")))
    total, rows = copies.count(), found.count()
    once = df.select(_doc(text_col).alias("_doc"), text_or_empty(text_col).alias("_text"))
    if total < rows:
        once = durable(once.dropDuplicates(["_doc"]))

    pairs = entity_terms(once, docs, total, support, generalise_at)
    flagged = durable(disclosing_terms(pairs, total, support, generalise_at))
    hits = join_spread(pairs.select("_doc", "entity", "term"), flagged.drop("n_ct"), ["entity", "term"], "_doc",
                       flagged.select("entity", "term", F.col("n_ct").alias("_n"))).select("_doc", "term", "disclosure")
    strong = flagged.filter((F.col("n_ct") >= elsewhere_support) & (F.col("disclosure") >= remove_at))
    strong = durable(strong.groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    other = durable(once.select("_doc", F.explode(_terms(_masked(F.col("_text")))).alias("term")).join(strong, "term"))
    bare = other.join(docs, "_doc", "left_anti").select("_doc").distinct()
    sources = docs.select("_doc", "masked").unionByName(
        once.join(bare, "_doc", "left_semi").select("_doc", _masked(F.col("_text")).alias("masked")))
    terms = hits.unionByName(other).groupBy("_doc", "term").agg((F.max("disclosure") >= remove_at).alias("remove"))
    terms = durable(terms.groupBy("_doc").agg(F.collect_list(F.when(F.col("remove"), F.col("term"))).alias("removed"),
                                              F.collect_list(F.when(~F.col("remove"), F.col("term"))).alias("softened")))
    hidden = sources.join(terms, "_doc").select("_doc", _hidden(F.col("masked"), F.col("removed"), F.col("softened")).alias("hidden"))
    dealt = join_spread(found.select("_id", "_doc", "base", "_at"), hidden, ["_doc"], "_at", copies, rows, "left")
    return dealt.select("_id", "_doc", "base", F.coalesce("hidden", F.array().cast(HIDDEN)).alias("hidden"))


def hide(text: Column, base: Column, hidden: Column) -> Column:
    """``text`` with base spans as ``[KIND]``, terms generalised or removed.

    Of overlapping spans the first names the replacement for all they cover.
    """
    spans = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                             F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("as"))),
        F.transform(hidden, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                               F.when(s["remove"], "").when(s["named"], "[name]").otherwise("[word]").alias("as"))),
    ))

    def piece(part: Column, offset: Column, x: Column) -> Column:
        return F.concat(part.substr(x["before"] - offset + 1, x["start"] - x["before"]), x["as"])

    def block(some: Column) -> Column:
        """The text up to the end of some spans; cut out first, so that places in it are near."""
        offset = F.element_at(some, 1)["before"]
        part = text.substr(offset + 1, F.element_at(some, -1)["start"] - offset)
        return let(F.struct(part.alias("part"), offset.alias("offset")), lambda c: F.array_join(
            F.transform(some, lambda x: piece(c["part"], c["offset"], x)), ""))

    def rebuilt(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: x["end"]), lambda x, y: F.greatest(x, y))

        def joined(r: Column) -> Column:
            placed = F.transform(s, lambda x, i: F.struct(
                x["start"].alias("start"), F.coalesce(F.get(r, i - 1), F.lit(0)).alias("before"), x["as"].alias("as")))
            blocks = let(F.filter(placed, lambda x: x["start"] >= x["before"]), lambda f: F.transform(
                F.sequence(F.lit(0), ((F.size(f) - 1) / BLOCK).cast("int")), lambda b: block(F.slice(f, b * BLOCK + 1, F.lit(BLOCK)))))
            return F.concat(F.array_join(blocks, ""), text.substr(F.element_at(r, -1) + 1, F.length(text)))

        return let(reach, joined)

    return F.when(F.size(base) + F.size(hidden) > 0, let(spans, rebuilt)).otherwise(text)


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with its texts sanitised; every row and column stays."""
    found = durable(detect(df, id_col, text_col, **options))
    sizes = found.groupBy("_doc").agg(F.count(F.lit(1)).alias("_n"))
    spans = found.filter(F.size("base") + F.size("hidden") > 0).dropDuplicates(["_doc"]).select("_doc", "base", "hidden")
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                      _doc(text_col).alias("_doc"), F.monotonically_increasing_id().alias("_at"))
    joined = join_spread(given, spans, ["_doc"], "_at", sizes, found.count(), "left")
    text = F.col("_row")[text_col]
    new = F.when(F.col("base").isNull(), text).otherwise(hide(text, F.col("base"), F.col("hidden")))
    return joined.select(*[(new if c == text_col else F.col("_row")[c]).alias(c) for c in df.columns])
