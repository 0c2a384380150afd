"""Secret scans with DataFrame functions only: patterns and Markov models.

Base spans are the matches of three patterns (see the fixed values below),
leftmost and non-overlapping per kind. Their places follow from the lengths of
the matches and of the parts between them (``split`` by the same pattern).

The method adds spans of kind ``markov``: two first-order Markov models over
characters, one of random strings and one of ordinary identifiers, score every
run of ``min_run`` or more token characters; a run whose log-likelihood ratio
per transition exceeds ``threshold`` and that meets no base span is a secret.
Both models are learned from labelled samples: of the corpus, the values that
the base patterns found (random) and the runs of ``train_run`` or more token
characters in documents without a base span (ordinary), each from at most
``sample`` documents, those with the smallest hash of their text; and of
``labelled_tokens``, strings made by rule that a corpus may lack: keys in the
alphabets of base64, base62 and lower-case base36 (random), and digit runs,
UUIDs, times, versions, and words joined by case, ``_``, ``-`` or ``/``,
upper-case constants among them
(ordinary, on purpose: an order number is no secret). Both are blended with
the uniform model. The learned table is a constant of the plan: 68 x 68
numbers, whatever the corpus.

Every step is a projection of the document's row: no shuffle of texts, so a
hot source or a group of copies costs what its rows cost.

Defined cases: null text counts as empty and has no span; an empty table gives
no rows; repeated rows each get their row; all columns are kept; names of the
results get underscores while a column of the input has them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm._shared import free_name, written

# The patterns of the base kinds, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
MIN_LENGTH = {"assign": 12, "access": 18, "hex": 16}
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
RUN = "[A-Za-z0-9+/_=-]"
# Share of the uniform distribution in the model of random strings (whose
# alphabet the samples need not show) and in that of ordinary identifiers.
UNIFORM = (0.3, 0.02)
SPANS = "array<struct<start:int,end:int>>"


def _spans(text: Column, pattern: str, keep) -> Column:
    """array<struct<start, end>> of the matches for which ``keep(match)`` holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _placed(text, pattern, found, F.transform(found, keep))


def _placed(text: Column, pattern: str, found: Column, kept: Column) -> Column:
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(found, F.length)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), sizes.alias("n"), kept.alias("ok"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        end = begin + s["n"]
        span = F.struct(begin.alias("start"), end.alias("end"))
        out = F.when(s["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    # Only kept matches are appended, so a text with many short ones stays linear.
    return F.when(F.exists(kept, lambda k: k), F.aggregate(steps, start, step, lambda a: a["out"])).otherwise(
        F.array().cast(SPANS)
    )


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds; ``end`` is exclusive, in code points."""
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    whole = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    long_enough = F.transform(value, lambda v: F.length(v) >= MIN_LENGTH["assign"])
    # A shorter run of these classes can hold no match that is long enough.
    access = f"AKIA[A-Z0-9]{{{MIN_LENGTH['access'] - 4},}}"
    hexes = f"[0-9a-f]{{{MIN_LENGTH['hex']},}}"
    return {
        "assign": _placed(text, ASSIGN, whole, long_enough),
        "access": _spans(text, access, lambda m: F.lit(True)),
        "hex": _spans(text, hexes, lambda m: F.lit(True)),
    }


def _values(text: Column) -> Column:
    """The strings that the base patterns take for secrets."""
    return F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_LENGTH["assign"]),
        F.regexp_extract_all(text, F.lit(f"AKIA[A-Z0-9]{{{MIN_LENGTH['access'] - 4},}}"), F.lit(0)),
        F.regexp_extract_all(text, F.lit(f"[0-9a-f]{{{MIN_LENGTH['hex']},}}"), F.lit(0)),
    )


def _indexes(token: Column) -> Column:
    return F.transform(
        F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1
    )


def _counts(tokens: DataFrame) -> DataFrame:
    """(kind, pair, n): transitions of the column ``token``; pair = from * 68 + to."""
    k = len(SYMBOLS)
    ids = tokens.select("kind", _indexes(F.col("token")).alias("i")).where(F.size("i") > 1)
    n = F.size("i")
    pairs = F.zip_with(F.slice("i", 1, n - 1), F.slice("i", 2, n - 1), lambda a, b: a * k + b)
    return ids.select("kind", F.explode(pairs).alias("pair")).groupBy("kind", "pair").agg(F.count("*").alias("n"))


def labelled_tokens(spark: SparkSession, n: int = 2000) -> DataFrame:
    """(token, kind): ``n`` strings of each of several forms, kind 0 random and
    1 ordinary, the same every time."""
    ids = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    raw = F.base64(F.unhex("h"))  # 43 characters of base64 and a sign
    plain = F.regexp_replace(raw, "[+/=]", "")
    digits = F.substring(F.regexp_replace("h", "[a-f]", ""), 1, 24)
    uuid = F.regexp_replace(F.substring("h", 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    time = F.date_format(F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id") * 86_399), "yyyy-MM-dd'T'HHmmss")
    version = F.concat_ws("-", F.lit("release"), F.col("id") % 37, F.col("id") % 101, F.col("id") % 7)
    syllable = lambda at: F.get(
        F.split(F.lit("user data file name list test value order total index page view table count group model start time"), " "),
        F.conv(F.substring("h", at, 2), 16, 10).cast("int") % 18,
    )
    four = [syllable(at) for at in (1, 3, 5, 7)]
    camel = F.concat(four[0], *[F.initcap(w) for w in four[1:]])
    joined_by = [F.concat_ws(sign, *four) for sign in ("_", "-", "/")]
    ordinary = [digits, uuid, time, version, camel, *joined_by, F.upper(joined_by[0])]
    random = [raw, plain, F.substring(F.lower(plain), 1, 32), F.concat(F.lit("key_"), F.substring(plain, 3, 30))]
    kinds = [(t, 0) for t in random] + [(t, 1) for t in ordinary]
    rows = F.array(*[F.struct(t.alias("token"), F.lit(kind).alias("kind")) for t, kind in kinds])
    return ids.select(F.explode(rows).alias("t")).select("t.*")


def train(docs: DataFrame, text_col: str = "text", sample: int = 2000, train_run: int = 6) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of the 68 x 68 transitions.

    The patterns read the whole corpus once, to write which texts hold a base
    span; the sampled texts are then fetched by their hashes.
    """
    spark, k = docs.sparkSession, len(SYMBOLS)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    held = written(rows.where("t <> ''").select("h", (F.size(_values(F.col("t"))) > 0).alias("held")), "held")

    def lowest(some: DataFrame) -> DataFrame:
        """The ``sample`` smallest hashes: hashes are ranked, not texts, and
        copies are combined before the shuffle."""
        return some.select("h").distinct().orderBy("h").limit(sample)

    chosen = lowest(held.where("held")).withColumn("kind", F.lit(0)).union(lowest(held.where("not held")).withColumn("kind", F.lit(1)))
    texts = rows.join(F.broadcast(chosen), "h").groupBy("h", "kind").agg(F.first("t").alias("t"))
    found = F.when(F.col("kind") == 0, _values(F.col("t"))).otherwise(
        F.regexp_extract_all("t", F.lit(f"{RUN}{{{train_run},}}"), F.lit(0))
    )
    of_corpus = texts.select(F.explode(found).alias("token"), "kind")
    counts = _counts(of_corpus.union(labelled_tokens(spark))).collect()  # at most 2 x 68 x 68 rows
    table = [[0] * (k * k), [0] * (k * k)]
    for r in counts:
        table[r.kind][r.pair] += r.n
    logs = []
    for t, blend in zip(table, UNIFORM, strict=True):
        totals = [sum(t[i * k : (i + 1) * k]) for i in range(k)]
        logs.append(
            [
                math.log((1 - blend) * t[i * k + j] / totals[i] + blend / k if totals[i] else 1 / k)
                for i in range(k)
                for j in range(k)
            ]
        )
    return [round(a - b, 4) for a, b in zip(*logs, strict=True)]


def ratio_per_transition(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions (0 for one character)."""
    k = len(SYMBOLS)
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    ids = _indexes(token)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        gain = F.when(acc["last"] >= 0, F.get(weights, acc["last"] * k + i)).otherwise(F.lit(0.0))
        return F.struct(i.alias("last"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(ids, start, step, lambda a: a["sum"]) / F.greatest(F.length(token) - 1, F.lit(1))


def scan(
    docs: DataFrame,
    model: list[float],
    text_col: str = "text",
    min_run: int = 16,
    threshold: float = 0.9,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with one column of spans per kind, and the names of those columns."""
    names = {kind: free_name(docs, f"{kind}_spans") for kind in KINDS}
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({names[kind]: spans for kind, spans in base_spans(text).items()})
    run = f"{RUN}{{{min_run},}}"
    found = F.regexp_extract_all(text, F.lit(run), F.lit(0))
    flagged = F.transform(found, lambda c: ratio_per_transition(c, model) > threshold)
    base = F.concat(*[F.col(names[kind]) for kind in KINDS[:3]])
    out = out.withColumn(names["markov"], _placed(text, run, found, flagged))
    return (
        out.withColumn(
            names["markov"],
            F.filter(
                names["markov"],
                lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
            ),
        ),
        names,
    )


def joined(names: dict[str, str], kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    def of_kind(i: int) -> Column:
        return F.transform(
            names[kinds[i]], lambda s: F.struct(s["start"].alias("s"), F.lit(i).alias("k"), s["end"].alias("e"))
        )

    tagged = F.concat(*map(of_kind, range(len(kinds))))
    kind_name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(
            F.array_sort(tagged),
            lambda x: F.concat_ws(":", F.get(kind_name, x["k"]), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )


def without_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every span replaced by ``mask``; texts without a span
    (and null texts) stay as they are, and so do all other columns."""
    scanned, names = scan(docs, train(docs, text_col), text_col, **options)
    text = F.col(text_col)
    spans = F.array_sort(F.concat(*[F.col(n) for n in names.values()]))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        # Overlapping spans become one mask.
        fresh = s["start"] + 1 >= acc["at"]
        kept = F.substring(text, acc["at"], s["start"] + 1 - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], F.array(kept, F.lit(mask)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), out.alias("out"))

    tail = F.aggregate(
        spans,
        start,
        step,
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"], F.length(text))),
    )
    cleaned = F.when(F.size(spans) > 0, tail).otherwise(text)
    return scanned.withColumn(text_col, cleaned).select(*docs.columns)
