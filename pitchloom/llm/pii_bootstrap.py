"""Personal data: fixed formats, and unseen identifiers found by bootstrapped contexts.

The formats give seed entities. The two words before an entity are its pattern, so patterns and
instances form a graph. In each round Spark scores patterns by the known instances they extract, takes
the confident ones, and lets them vouch for new instances, which count as known in the next round.
The whole path is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitchloom.runtime import staged

# Kinds in their listed order and their formats. Quantifiers are possessive and starts
# are tied to the start of a run of characters (or the end of the match before), which changes no
# match but keeps long runs linear.
KINDS = ("email", "ip", "card", "phone")
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Shapes of unseen identifiers: a whole word with a digit, of 6 to 64 characters, edges trimmed.
IDENTIFIER = (
    r"(?<![^\x20\x09-\x0D])[A-Za-z0-9](?=[A-Za-z0-9_.:/#@+-]{0,63}+(?:[\x20\x09-\x0D,;!?\"')]|$))"
    r"(?=[^\x20\x09-\x0D]{0,63}[0-9])[A-Za-z0-9_.:/#@+-]{4,62}[A-Za-z0-9]"
)
# Characters before a match from which its two words of context are taken.
CONTEXT_CHARS = 80
# Rounds; different known instances and share of a pattern's uses that make it confident; certainty
# that makes an instance known.
ROUNDS, LEAST_SUPPORT, LEAST_PRECISION, LEAST_CERTAINTY = 3, 3, 0.5, 0.7
# Word pairs fall into so many buckets; pairs in a bucket without a pattern are not counted.
BUCKETS = 16_384
# Confident patterns that are put into the plan as a map; if there are more, they are joined.
MAP_PATTERNS = 2_000

# Fields stand in the order that spans are sorted by: start, kind, end.
SPAN = "array<struct<s:int,k:int,e:int,m:string,c:string>>"


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """Matches in order: start and end in code points, number of the kind, text, text before.

    Splitting at a pattern and extracting it use the same matches, so the pieces between them give
    the places without a second search.
    """
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def step(held, pair):
        start = held["at"] + F.length(pair["p"])
        end = start + F.length(pair["m"])
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), pair["m"].alias("m"),
                        F.substring(pair["p"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("c"))
        return F.when(pair["m"].isNull(), held).otherwise(F.struct(
            end.alias("at"), F.concat(held["out"], F.array(span)).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(pairs, start, step, lambda held: held["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Every second digit from the right is doubled, and digits of all results add up to tens."""
    digits = F.split(F.reverse(_digits(text)), "")
    values = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str):
    def ip(span):
        # Up to three digits once leading zeros are gone, so that no long run is cast.
        return F.forall(F.split(span["m"], r"\."), lambda part: part.rlike(
            "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))

    def card(span):
        return F.length(_digits(span["m"])).between(14, 19) & _luhn(span["m"])

    def phone(span):
        return F.length(_digits(span["m"])).between(10, 15)

    return {"email": lambda span: F.lit(True), "ip": ip, "card": card, "phone": phone}[kind]


def base_spans(text: Column) -> Column:
    """Spans of the four formats, by start, then by kind."""
    none = F.array().cast(SPAN)
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"),
             "card": text.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": text.contains("+")}
    found = [
        F.when(needs[kind], F.filter(_matches(text, number, FORMATS[kind]), _valid(kind))).otherwise(none)
        for number, kind in enumerate(KINDS)
    ]
    return F.array_sort(F.concat(*found))


def candidate_spans(text: Column) -> Column:
    """Identifier-shaped words; the kind is open (-1)."""
    return F.when(text.rlike("[0-9]"), _matches(text, -1, IDENTIFIER)).otherwise(F.array().cast(SPAN))


def _pattern(context: Column) -> Column:
    """The last two words of a context, lower-cased, without marks at their edges; empty if fewer."""
    words = F.regexp_extract(F.lower(context), r"(\S+)[\x20\x09-\x0D]+(\S+)[\x20\x09-\x0D]*$", 0)
    trimmed = F.regexp_replace(words, r"[^\p{L}\p{N}=:#]*[\x20\x09-\x0D]+[^\p{L}\p{N}=:#]*", " ")
    return F.trim(trimmed)


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["s"] < span["e"]) & (span["s"] < o["e"]))


def mentions(docs: DataFrame) -> DataFrame:
    """(pattern, instance, kind): seeds with their kind, identifier-shaped words with kind -1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = (
        docs.select(text.alias("text")).where(F.col("text").rlike("[0-9@]"))
        .select(base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("open"))
        .select(F.explode(F.concat(
            F.col("base"), F.filter("open", lambda o: ~_overlaps(o, F.col("base"))))).alias("x"))
        .select(_pattern(F.col("x.c")).alias("pattern"), F.col("x.m").alias("instance"), F.col("x.k").alias("kind"))
    )
    return found.where("pattern <> ''").groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n"))


def _bucket(pattern: str) -> Column:
    return F.pmod(F.xxhash64(pattern), F.lit(BUCKETS)).cast("int")


def pattern_uses(docs: DataFrame, pool: DataFrame) -> DataFrame:
    """(pattern, uses): how often the patterns of ``pool`` stand before any word.

    Pairs are counted before they meet the pool, so the join sees each pair once. The buckets that
    the pool falls into, BUCKETS at most, keep most other pairs from being counted.
    """
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    words = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}=:#]*[\x20\x09-\x0D]+[^\p{L}\p{N}=:#]*", " "), " ")
    pairs = docs.select(F.explode(F.arrays_zip(
        words.alias("a"), F.slice(words, 2, 1 << 30).alias("b"))).alias("z")).select("z.a", "z.b")
    buckets = [row[0] for row in pool.select(_bucket("pattern")).distinct().collect()]
    used = (
        pairs.where("b is not null").select(F.concat_ws(" ", "a", "b").alias("pattern"))
        .where(_bucket("pattern").isin(buckets))
    )
    return used.groupBy("pattern").agg(F.count(F.lit(1)).alias("uses")).join(pool, "pattern")


def confident_patterns(docs: DataFrame, rounds: int = ROUNDS, least_support: int = LEAST_SUPPORT,
                       least_precision: float = LEAST_PRECISION) -> DataFrame:
    """(pattern, kind) of the confident patterns, learnt over all rows of ``docs``."""
    graph = staged(mentions(docs))
    seeds = graph.where("kind >= 0")
    # Instances found later count too, so a pattern can enter in any round: the pool has all patterns
    # with instances enough, known yet or not. No other one can ever have the support.
    support = graph.groupBy("pattern").agg(F.countDistinct("instance").alias("support"))
    pool = staged(support.where(F.col("support") >= least_support).select("pattern"))
    if pool.isEmpty():
        return pool.select("pattern", F.lit(0).alias("kind"))
    edges = staged(graph.join(pool, "pattern"))
    uses = staged(pattern_uses(docs, pool))
    known = seeds.select("instance", "kind").distinct().withColumn("certainty", F.lit(1.0))
    confident = None
    for _ in range(rounds):
        extracted = edges.select("pattern", "instance", "n").join(known, "instance")
        scored = (
            extracted.groupBy("pattern", "kind")
            .agg(F.countDistinct("instance").alias("support"), F.sum(F.col("n") * F.col("certainty")).alias("mass"))
            .join(uses, "pattern")
            .withColumn("precision", F.col("mass") / F.greatest("mass", F.col("uses").cast("double")))
            .where((F.col("support") >= least_support) & (F.col("precision") >= least_precision))
        )
        # A pattern speaks for the kind that it extracts most surely.
        confident = staged(
            scored.groupBy("pattern").agg(F.max_by("kind", F.struct("precision", "support", "kind")).alias("kind"),
                                          F.max("precision").alias("precision"))
        )
        new = (
            edges.where("kind < 0").join(confident.withColumnRenamed("kind", "k"), "pattern")
            .groupBy("instance", F.col("k").alias("kind"))
            .agg((1 - F.exp(F.sum(F.log(1.000001 - F.col("precision"))))).alias("certainty"))
            .where(F.col("certainty") >= LEAST_CERTAINTY)
        )
        known = staged(
            seeds.select("instance", "kind", F.lit(1.0).alias("certainty")).unionByName(new)
            .groupBy("instance", "kind").agg(F.max("certainty").alias("certainty"))
        )
    return confident.select("pattern", "kind")


def learn_patterns(docs: DataFrame, **options) -> list[tuple[str, int]]:
    """The confident patterns as a sorted list, to look at."""
    return [(row["pattern"], row["kind"]) for row in confident_patterns(docs, **options).orderBy("pattern").collect()]


def _typed(span: Column, kind: Column) -> Column:
    return F.struct(span["s"].alias("s"), kind.alias("k"), span["e"].alias("e"), span["m"].alias("m"), span["c"].alias("c"))


def _by_map(docs: DataFrame, patterns: list[tuple[str, int]]) -> DataFrame:
    """``docs`` with _more, the candidates that a pattern of a short list precedes. Moves no row."""
    if not patterns:
        return docs.withColumn("_more", F.array().cast(SPAN))
    kinds = F.map_from_arrays(F.array(*[F.lit(p) for p, _ in patterns]), F.array(*[F.lit(k) for _, k in patterns]))
    typed = F.transform(candidate_spans(F.coalesce(F.col("text"), F.lit(""))), lambda span: _typed(
        span, F.coalesce(F.element_at(kinds, _pattern(span["c"])), F.lit(-1))))
    return docs.withColumn("_more", F.filter(typed, lambda span: span["k"] >= 0))


def _by_join(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same for a table of patterns of any length. Spans depend on the text alone, so the text's
    digest is their key and the copies of a text share one row of spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = (
        docs.where(F.col("text").rlike("[0-9]"))
        .select(F.sha2("text", 256).alias("_digest"), F.explode(candidate_spans(F.col("text"))).alias("x"))
        .withColumn("pattern", _pattern(F.col("x.c"))).where("pattern <> ''")
        .join(patterns, "pattern")
        .groupBy("_digest").agg(F.array_sort(F.collect_set(_typed(F.col("x"), F.col("kind")))).alias("_more"))
    )
    return (
        docs.withColumn("_digest", F.sha2(text, 256)).join(found, "_digest", "left").drop("_digest")
        .withColumn("_more", F.coalesce("_more", F.array().cast(SPAN)))
    )


def _listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """The columns of ``docs`` (text and any others) with _base and _all, arrays of spans.

    Null texts count as empty. Spans that patterns add never overlap a base span. ``patterns`` are
    rows (pattern, kind), each pattern once; they are learnt from ``docs`` itself if none are given.
    """
    patterns = confident_patterns(docs) if patterns is None else patterns
    few = patterns.limit(MAP_PATTERNS + 1).collect()
    found = _by_map(docs, [tuple(row) for row in few]) if len(few) <= MAP_PATTERNS else _by_join(docs, patterns)
    found = found.withColumn("_base", base_spans(F.coalesce(F.col("text"), F.lit(""))))
    free = F.filter("_more", lambda o: ~_overlaps(o, F.col("_base")))
    return found.withColumn("_all", F.array_sort(F.concat("_base", free))).drop("_more")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``."""
    found = find(docs.select("doc_id", "text")).drop("text")

    def count(number):
        # One parameter only: a second one would be handed the place in the array.
        return F.size(F.filter("_base", lambda x: x["k"] == number)).cast("long")

    counts = [count(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.col("_all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets, and n_chars to match.

    Spans that overlap are replaced as one, under the kind of the first. Null texts stay null.
    """
    marks = F.array(*[F.lit(f"<{kind.upper()}>") for kind in KINDS])

    def step(held, span):
        begin = F.greatest(span["s"], held["at"])
        put = F.concat(
            held["out"],
            F.when(span["s"] >= held["at"], F.concat(
                F.substring(F.col("text"), held["at"] + 1, begin - held["at"]), F.element_at(marks, span["k"] + 1)))
            .otherwise(F.lit("")))
        return F.struct(F.greatest(span["e"], held["at"]).alias("at"), put.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate("_all", start, step, lambda held: F.concat(
        held["out"], F.substring(F.col("text"), held["at"] + 1, F.length("text") - held["at"])))
    # The row travels whole, so no column of it can clash with those that are found.
    found = find(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    clean = found.withColumn("_clean", F.when(F.size("_all") > 0, text).otherwise(F.col("text")))
    columns = [
        F.col("_clean").alias("text") if c == "text"
        else F.when(F.size("_all") > 0, F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars")).alias("n_chars")
        if c == "n_chars" else F.col("_row").getField(c).alias(c) for c in docs.columns
    ]
    return clean.select(*columns)
