"""Secret scans through a trigram inverted index.

The index is built once from the texts' own trigrams and stored: postings (trigram, name of a row), in segments sorted by trigram, so that
a scan reads the pages of the trigrams it asks for only, and other rules are answered from the same index. From each rule's regular expression a Boolean
query over trigrams is derived that every matching text satisfies. Postings are intersected per rule, candidates are
verified by the expression itself, and a rule without mandatory trigrams scans all texts. DataFrame functions only.

Trigrams are of lower-case text and kept as 32-bit hashes, names as 32 bits of a row's key: what collides is a candidate more, and fails
to verify.

Defined results: a null or empty text has no spans; repeated rows are answered alike; a very long text is indexed in overlapping pieces, and
searched as one; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove_at_exit, row_keys, shared_dir, stored

#: Strings that a part of an expression may stand for before it counts as unknown.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and without overlap, whose group has at least least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The kinds (fixed values): the first three are the base, in order.
RULES = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

# --- Boolean trigram queries -------------------------------------------------------------------------------------------
# A query is a frozenset of alternatives; each alternative is a frozenset of trigrams that must all occur. ANY asks for nothing.
Query = frozenset
ANY: Query = frozenset([frozenset()])


def both(a: Query, b: Query) -> Query:
    return simple(frozenset(x | y for x in a for y in b))


def either(a: Query, b: Query) -> Query:
    return simple(a | b)


def simple(q: Query) -> Query:
    """Without alternatives that ask for more than another does."""
    return frozenset(x for x in q if not any(y < x for y in q))


def query_of_strings(strings: set[str]) -> Query:
    return simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _parts(tree: object) -> tuple[set[str] | None, Query]:
    """The strings that an expression's part can be, if few, else None and what it asks for."""
    run: set[str] = {""}
    query = ANY
    exact = True
    for op, arg in tree:
        strings, own = _item(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query = both(both(query, query_of_strings(run)), query_of_strings(strings) if strings is not None else own)
        run, exact = {""}, False
    if exact:
        return run, ANY
    return None, both(query, query_of_strings(run))


def _item(op: object, arg: object) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is C.IN:
        letters: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                letters.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < MOST_STRINGS:
                letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (letters, ANY) if len(letters) <= 6 else (None, ANY)
    if op is C.SUBPATTERN:
        return _parts(arg[-1])
    if op is C.BRANCH:
        found = [_parts(x) for x in arg[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), ANY
        return None, reduce(either, (query_of_strings(s) if s is not None else q for s, q in found))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, sub = arg
        strings, query = _parts(sub)
        if strings is not None and high == 1:
            return strings | ({""} if low == 0 else set()), ANY
        if strings is not None and low == high and low <= 8:
            made = {""}
            for _ in range(low):
                made = {a + b for a in made for b in strings}
                if len(made) > MOST_STRINGS:
                    return None, ANY
            return made, ANY
        if low == 0:
            return None, ANY
        return None, query_of_strings(strings) if strings is not None else query
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """What the trigrams of any text that matches must satisfy, in lower case; ANY if nothing is mandatory."""
    strings, query = _parts(parser.parse(pattern))
    return query_of_strings(strings) if strings is not None else query


# --- Index, candidates, verification -----------------------------------------------------------------------------------


#: Code points of a text that are indexed at once.
PIECE = 1 << 16
#: Values that one filter on postings lists, so that it reaches the pages of a file.
LISTED = 10


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2, name) of docs: name is 32 bits of k1."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", "text", *row_keys("id"))
    return rows.withColumn("name", (F.col("k1").bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int"))


class TrigramIndex:
    """Postings of documents in a folder, a segment a call of add."""

    SCHEMA = "trigram int, name int"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}"
        if path is None:
            remove_at_exit(spark, self.path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TrigramIndex:
        """Indexes every trigram of every text. Each task sorts and writes its own rows: nothing is shuffled."""
        low = named(docs, id_col, text_col).select("name", F.lower("text").alias("low"))
        pieces = low.select("name", "low", F.explode(F.sequence(F.lit(0), F.greatest(F.length("low") - 1, F.lit(0)), F.lit(PIECE))).alias("at"))
        pieces = pieces.select("name", F.when(F.length("low") > PIECE, F.substring("low", F.col("at") + 1, F.lit(PIECE + 2))).otherwise(F.col("low")).alias("piece"))
        grams = pieces.select("name", F.explode(F.array_distinct(F.regexp_extract_all("piece", F.lit("(?s)(?=(...))"), F.lit(1)))).alias("gram"))
        packed = grams.select((F.shiftleft(F.hash("gram").cast("long"), 32) + (F.col("name").cast("long") + (1 << 31))).alias("p")).sortWithinPartitions("p")
        postings = packed.select(F.shiftright("p", 32).cast("int").alias("trigram"), (F.col("p").bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int").alias("name"))
        postings.write.parquet(f"{self.path}/segment={uuid.uuid4().hex}")
        return self

    def postings(self, trigrams: list[str]) -> DataFrame:
        """(number of the trigram in the list, name)."""
        hashes = list(self.spark.range(1).select(F.array(*[F.hash(F.lit(t)) for t in trigrams])).first()[0])
        wanted = [F.col("trigram").isin(hashes[i : i + LISTED]) for i in range(0, len(hashes), LISTED)]
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(reduce(lambda a, b: a | b, wanted))
        return rows.select((F.array_position(F.array(*map(F.lit, hashes)), F.col("trigram")) - 1).cast("int").alias("trigram"), "name")

    def candidates(self, queries: dict[str, Query]) -> DataFrame:
        """(name, is_<kind>): the rows whose postings satisfy a rule's query."""
        trigrams = sorted({t for q in queries.values() for needed in q for t in needed})
        number = {t: i for i, t in enumerate(trigrams)}
        width = 60
        words = range((len(trigrams) + width - 1) // width)
        masks = [F.bit_or(F.when(F.floor(F.col("trigram") / width) == w, F.expr(f"shiftleft(1L, cast(trigram % {width} as int))")).otherwise(F.lit(0).cast("long"))).alias(f"mask{w}") for w in words]
        df = self.postings(trigrams).groupBy("name").agg(*masks)

        def holds(query: Query) -> Column:
            made = F.lit(False)
            for needed in sorted(query, key=sorted):
                all_of = F.lit(True)
                for w in words:
                    bits = sum(1 << (number[t] % width) for t in needed if number[t] // width == w)
                    if bits:
                        all_of = all_of & (F.col(f"mask{w}").bitwiseAND(F.lit(bits)) == bits)
                made = made | all_of
            return made

        found = df.select("name", *[holds(q).alias(f"is_{k}") for k, q in queries.items()])
        return found.where(reduce(lambda a, b: a | b, [F.col(f"is_{k}") for k in queries]))


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, order, kind, end) in code points: what lies between matches gives their places."""
    rx = F.lit(rule.pattern)
    values = F.regexp_extract_all(text, rx, F.lit(rule.group))
    whole = F.regexp_extract_all(text, rx, F.lit(0)) if rule.group else values
    items = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("len"), F.transform(values, lambda x: F.length(x)).alias("value"))
    none = F.expr("cast(array() as array<struct<start:int,order:int,kind:string,end:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["value"] >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(items, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


NONE = "cast(array() as array<struct<start:int,order:int,kind:string,end:int>>)"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", index: TrigramIndex | None = None) -> DataFrame:
    """Per row: id, n_<kind> for the base kinds, base_spans and spans (arrays of start, order, kind, end in code points).

    index: one that holds all rows of docs; without one, docs are indexed for this call. Texts stay where they are but for
    candidates, where these are too many to go to the tasks.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q != ANY}
    rows = named(docs, id_col, text_col)
    places = {r.kind: i for i, r in enumerate(rules)}
    every = []
    for rule in rules:
        if rule.kind not in asked:
            # One pass without captures tells which texts can hold a match that is long enough.
            maybe = F.col("text").rlike(f"(?:{rule.pattern[:-1]}){{{rule.least},}}" if rule.pattern.endswith("]+") and rule.pattern.startswith("[") else rule.pattern)
            every.append(F.when(maybe, spans_of(rule, places[rule.kind], F.col("text"))).otherwise(F.expr(NONE)).alias(f"s_{rule.kind}"))
    found = rows.select("id", "k1", "k2", *every)
    if asked:
        flags = stored((index or TrigramIndex(docs.sparkSession).add(docs, id_col, text_col)).candidates(asked), "candidates")
        verified = [F.when(F.col(f"is_{r.kind}"), spans_of(r, places[r.kind], F.col("text"))).otherwise(F.expr(NONE)).alias(f"s_{r.kind}") for r in rules if r.kind in asked]
        hits = rows.join(flags, "name").select("k1", "k2", *verified).where(reduce(lambda a, b: a | b, [F.size(f"s_{k}") > 0 for k in asked]))
        found = found.join(stored(hits, "verified").dropDuplicates(["k1", "k2"]), ["k1", "k2"], "left")
        found = found.withColumns({f"s_{k}": F.coalesce(f"s_{k}", F.expr(NONE)) for k in asked})
    base = [r for r in rules if r.base]
    ordered = lambda own: F.array_sort(F.concat(F.expr(NONE), *[F.col(f"s_{r.kind}") for r in own]))
    return found.select(F.col("id").alias(id_col), *[F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base], ordered(base).alias("base_spans"), ordered(rules).alias("spans"))
