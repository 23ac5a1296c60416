"""Secret scans: regular expressions find candidates, a random forest removes false positives.

Candidates are provider formats, assignments to telling names, and long unbroken runs. The forest
looks at a candidate's length and character transitions, its dictionary coverage (the share of its
letter trigrams that occur in words of corpus frequency ``FREQUENT`` at least), whether it is part
of a path or address, and its neighbouring words; all features are SQL expressions. It is trained on
labelled findings: equal ones are one with a weight, and of each label at most half of ``SAMPLE`` distinct ones, those
with the smallest hash of value and context; both labels weigh the same, however rare one is. Where nobody has
labelled findings, ``weak_labels`` gives the certain ones: strict provider formats and assigned hex or
mixed values against plain words; what it leaves open is for the forest. (The given tables have no labels of findings;
weak labels follow the same features that the forest sees, so on them it learns little beyond the rule.) It
never overrules a provider's strict format.

Dictionary counts cover all documents; at most 1 / FREQUENT words pass. Texts are read once for the
counts and once for the candidates, and never shuffled.

Defined results: null and empty texts have no findings; repeated rows have theirs each; null doc_ids
are kept; without labelled findings of both kinds there is no forest and every finding is judged for
itself (``rule``); an empty table gives no rows; other columns are not looked at.
"""
from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_or_shuffled, words

NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth"
KINDS = {
    "aws": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36}",
    "gitlab": r"glpat-[A-Za-z0-9_-]{20}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,72}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "stripe": r"[sr]k_live_[0-9A-Za-z]{24,99}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    # through the END line; where that is lost, with the lines of base64 that follow
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\s-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:\s{1,2}[A-Za-z0-9+/=]{16,76}){0,200})",
    "assigned": rf"(?i:{NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?[^\s\"']{{6,}}",
    "run": r"[A-Za-z0-9+/_=-]{20,}",
}
STRICT = [k for k in KINDS if k not in ("assigned", "run")]  # the format alone says what it is
PATTERN = "|".join(KINDS.values())
VALUE = rf"^(?i:{NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
FREQUENT, SAMPLE, CONTEXT = 1e-4, 20_000, 60
TREES, DEPTH, SEED = 20, 6, 7
FEATURES = ["length", "transitions", "digit_share", "upper_share", "distinct_share", "hex_share", "vowel_share", "dictionary",
            "slashes", "in_path", "in_address", "named", "assigned", "quoted", "excused", "plain_neighbours"]


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, th, start, length (code points), kind, value, before, after of every candidate."""
    hit = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", PATTERN, -1).alias("parts"),
                      F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("hits")) \
        .where(F.size("hits") > 0).withColumn("row", F.monotonically_increasing_id())
    rows = hit.select("row", "doc_id", "th", F.posexplode(F.arrays_zip("hits", F.slice("parts", F.lit(1), F.size("hits")).alias("l"), F.slice("parts", F.lit(2), F.size("hits")).alias("r"))).alias("k", "z")) \
        .select("row", "doc_id", "th", "k", F.col("z.hits").alias("match"), F.length("z.hits").alias("whole"), F.length("z.l").alias("gap"),
                F.right("z.l", F.lit(CONTEXT)).alias("before"), F.left("z.r", F.lit(CONTEXT)).alias("after"))
    so_far = F.sum(F.col("gap") + F.col("whole")).over(Window.partitionBy("row").orderBy("k")) - F.col("whole")
    kind = F.lit("run")
    for name, pattern in reversed([(n, p) for n, p in KINDS.items() if n != "run"]):
        kind = F.when(F.col("match").rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    value = F.regexp_replace("match", VALUE, "")
    told = rows.withColumns({"kind": kind, "at": so_far, "value": value})
    lead = F.substring("match", F.lit(1), F.length("match") - F.length("value"))
    return told.select("row", "doc_id", "th", "k", (F.col("at") + F.length(lead)).cast("long").alias("start"), F.length("value").cast("long").alias("length"),
                       "kind", "value", F.concat("before", lead).alias("before"), "after")


def dictionary(docs: DataFrame, frequent: float = FREQUENT) -> DataFrame:
    """Trigrams of the frequent words of letters (1 / frequent words at most), stored."""
    plain = F.regexp_replace(F.lower(F.col("w")), r"^\P{L}+|\P{L}+$", "")
    counts = saved(docs.select(F.explode(words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
    whole = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.groupBy(plain.alias("word")).agg(F.sum("n").alias("n")).where((F.col("n") >= max(1, frequent * whole)) & F.col("word").rlike(r"^\p{L}{3,12}$"))
    return saved(often.select(F.explode(_trigrams(F.col("word"))).alias("gram")).distinct(), "dictionary")


def _trigrams(text: Column) -> Column:
    letters = F.regexp_replace(F.lower(text), r"\P{L}+", "")
    return F.when(F.length(letters) >= 3, F.transform(F.sequence(F.lit(1), F.length(letters) - 2), lambda i: F.substring(letters, i, F.lit(3)))) \
        .otherwise(F.array().cast("array<string>"))


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", pattern, "")) / F.greatest(F.length("value"), F.lit(1))


def features(found: DataFrame, grams: DataFrame) -> DataFrame:
    """``found`` (row, k, value, before, after) with the columns of FEATURES."""
    told = found.select("row", "k", F.explode_outer(_trigrams(F.col("value"))).alias("g")).join(F.broadcast(grams), F.col("g") == F.col("gram"), "left") \
        .groupBy(F.col("row").alias("r"), F.col("k").alias("j")).agg((F.count("gram") / F.greatest(F.count("g"), F.lit(1))).alias("dictionary"))
    classes = F.col("value")
    for pattern, sign in (("[A-Z]", "\u0001"), ("[a-z]", "\u0002"), ("[0-9]", "\u0003"), ("[^\u0001-\u0003]", "\u0004")):
        classes = F.regexp_replace(classes, pattern, sign)
    near = F.concat_ws(" ", "before", "after")

    def yes(condition: Column) -> Column:
        return condition.cast("double")

    both = found.join(told, (F.col("row") == F.col("r")) & (F.col("k") == F.col("j"))).drop("r", "j")
    return both.withColumns({
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1) / F.greatest(F.length("value"), F.lit(1)),
        "digit_share": _share("[^0-9]"), "upper_share": _share("[^A-Z]"), "hex_share": _share("[^0-9a-fA-F]"), "vowel_share": _share("[^aeiouAEIOU]"),
        "distinct_share": F.size(F.array_distinct(F.split("value", ""))) / F.greatest(F.length("value"), F.lit(1)),
        "slashes": _share("[^/]"), "in_path": yes(F.col("before").rlike(r"(?:[/\\]|www\.)\S*$") | F.col("after").rlike(r"^(?:/|\.[a-z]{2,4}\b)")),
        "in_address": yes(F.col("after").rlike(r"^\S*@") | F.col("before").rlike(r"@\S*$")),
        "named": yes(F.col("before").rlike(rf"(?i:{NAMES})\W{{0,6}}$")), "assigned": yes(F.col("before").rlike(r"[:=]\s*[\"']?$")),
        "quoted": yes(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "excused": yes(near.rlike(r"(?i)\b(?:example|sample|dummy|placeholder|changeme|fake)\b")),
        "plain_neighbours": F.regexp_count(near, F.lit(r"\b\p{L}{2,}\b")).cast("double"),
        "length": F.col("length").cast("double")})


def _certain() -> Column:
    """1 or 0 for a finding that is certain, null for the others."""
    mixed = (F.col("digit_share") > 0) & (F.col("dictionary") < 0.5)
    sure = F.col("kind").isin(STRICT) | ((F.col("kind") == "assigned") & mixed & (F.col("excused") == 0))
    plain = (F.col("kind") == "run") & (F.col("digit_share") == 0) & (F.col("transitions") < 0.1) & (F.col("named") == 0)
    return F.when(sure, 1.0).when(plain, 0.0)


def weak_labels(told: DataFrame) -> DataFrame:
    """The findings (with features) that are certain, with label 1 or 0."""
    return told.withColumn("label", _certain()).where("label IS NOT NULL")


def rule() -> Column:
    """1 or 0 for every finding, from itself alone: what is not certain is a secret if it is not made of
    words and neither excused nor a path or an address or part of one."""
    random = (F.col("dictionary") < 0.5) & (F.col("slashes") < 0.1) & (F.col("excused") == 0) & (F.col("in_path") == 0) & (F.col("in_address") == 0)
    return F.coalesce(_certain(), random.cast("double"))


def train(labelled: DataFrame, sample: int = SAMPLE):
    """A forest fitted on at most ``sample`` distinct labelled findings, half of each label, or None if a
    label is missing. The rows and their order do not depend on the run, so neither does the forest."""
    one = ["value", "before", "after", "label"]
    groups = saved(labelled.groupBy(*one, *FEATURES).agg(F.count(F.lit(1)).alias("n")), "labelled_groups")
    order = [F.xxhash64("value", "before", "after"), *one, *FEATURES]
    kinds = [r["label"] for r in groups.select("label").distinct().orderBy("label").collect()]
    if len(kinds) < 2:
        return None
    parts = [groups.where(F.col("label") == k).orderBy(*order).limit(sample // len(kinds)) for k in kinds]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    taken = saved(both.coalesce(1), "taken")
    whole = {r["label"]: r["n"] for r in taken.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    scale = F.lit(0.0)
    for k, n in whole.items():
        scale = F.when(F.col("label") == k, sum(whole.values()) / (len(whole) * n)).otherwise(scale)
    rows = saved(taken.withColumn("weight", F.col("n") * scale).coalesce(1).sortWithinPartitions(*order).select("label", "weight", *FEATURES), "labelled")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="vector", labelCol="label", weightCol="weight")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows))


def classify(told: DataFrame, model) -> DataFrame:
    """``told`` with probability (rounded to 6 places) and is_secret; by ``rule`` where there is no model. A provider's
    strict format is a secret whatever the forest says."""
    if model is None:
        out = told.withColumn("probability", rule())
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(told))
        out = scored.withColumn("probability", F.round(vector_to_array(F.col("probability"))[1], 6)).drop("vector", "rawPrediction", "prediction")
    return out.withColumn("is_secret", (F.col("probability") >= 0.5) | F.col("kind").isin(STRICT))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row for each candidate: doc_id, th, start, length, kind, value_sha256, the features,
    probability, is_secret. ``labelled`` has value, before, after, label and the features."""
    told = saved(features(saved(candidates(docs), "candidates"), dictionary(docs)), "findings")
    model = train(weak_labels(told) if labelled is None else labelled)
    return classify(told, model).withColumn("value_sha256", F.sha2("value", 256)).withColumn("length", F.col("length").cast("long")).drop("row", "k", "value", "before", "after")


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``findings`` replaced by ``mark`` (``n_chars`` to match, if there).
    No row is lost; documents without secrets are unchanged."""
    spans = findings.where("is_secret").groupBy(F.col("doc_id").alias("__own_d"), F.col("th").alias("__own_t")) \
        .agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("__own_spans"))
    spans = saved(spans, "spans")
    both = docs.withColumn("__own_th", F.xxhash64("text")).join(small_or_shuffled(spans, 128), F.col("doc_id").eqNullSafe(F.col("__own_d")) & (F.col("__own_th") == F.col("__own_t")), "left")
    ends = F.transform("__own_spans", lambda s, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("__own_spans", i - 1)["start"] + F.get("__own_spans", i - 1)["length"]))
    kept = F.transform(F.arrays_zip("__own_spans", ends.alias("e")), lambda z: F.substring("text", (z["e"] + 1).cast("int"), (z["__own_spans"]["start"] - z["e"]).cast("int")))
    last = F.element_at("__own_spans", -1)
    tail = F.substring("text", (last["start"] + last["length"] + 1).cast("int"), F.length("text"))
    out = both.withColumn("__own_new", F.when(F.col("__own_spans").isNotNull(), F.concat(F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit(mark))), ""), tail)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__own_new").isNotNull(), F.length("__own_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce("__own_new", "text")).select(*docs.columns)
