"""Secret scans: candidate strings, and a random forest that removes the false positives.

Candidates are long strings of key characters with a digit or an issuer's head, and whatever follows a
naming word and ``=`` or ``:``. The forest sees their length, character classes and transitions, how
likely their letters follow each other in the corpus, how much of them is dictionary words, words of the
path and the neighbouring words. Only DataFrame functions and the forest of Spark's own library are used.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescan.llm.text import stored

#: Fixed value: what a candidate is made of.
CANDIDATE = r"[A-Za-z0-9+/_-]{12,}={0,2}"

#: Words that name a secret next to it.
NAMING = "(?i)(secret|token|passw|passphrase|pwd|api.?key|access.?key|private.?key|credential|auth|bearer|_key|key$)"

#: A naming word and the sign that assigns; they are at most 40 characters apart.
ASSIGNED = (
    "(?i)(?:secret|token|passw|pass.?phrase|pwd|key|credential|auth|bearer)[^\\s=:]{0,40}?[\"'`]?\\s?(?::=|=>|[=:]+)>?"
)

#: Quotes, brackets and stops around an assigned value.
OPENING, CLOSING = "^[\"'`(\\[{<]+", "[\"'`,;)\\]}>]+$"

#: So many characters before a word are searched for a naming word.
REACH = 120

#: Words of a path where keys are kept, and where they are made up.
KEEPING = "(?i)(config|env|secret|credential|deploy|settings|vault)"
TRYING = "(?i)(test|example|sample|fixture|mock|docs|demo)"

#: What stands for a value that is given elsewhere.
PLACEHOLDERS = ["none", "null", "true", "false", "string", "required", "xxxxxxxx", "********", "${PASSWORD}", "your-token"]

#: The most frequent words, which are no secrets where a naming word stands before them.
COMMON_WORDS = 500

#: Heads by which issuers mark their keys.
HEADS = r"(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-|sk_live_|AIza[A-Za-z0-9_-]{35}"
ISSUED = f"^({HEADS})"

#: Labelled findings that the forest is trained on at most: generated, and taken from the table.
GENERATED, FROM_TABLE = 6_000, 6_000

#: A word is in the dictionary if the corpus has it so often.
DICTIONARY_COUNT = 3

LETTERS = "abcdefghijklmnopqrstuvwxyz"

INPUTS = [
    "length", "digits", "uppers", "lowers", "symbols", "changes", "distinct", "likelihood", "coverage", "named",
    "assigned", "quoted", "issued", "before_length", "after_length", "path_keeps", "path_tries",
]


def candidates(documents: DataFrame) -> DataFrame:
    """``doc_id, path, row, places``: the words of each text that may hold a candidate, with neighbours.

    A place has the word's number ``at``, the ``word``, the two words ``before`` and the one ``after``.
    ``path`` is the source column if there is one. NULL and empty texts have no places.
    """
    path = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
    words = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\\s+")
    rows = documents.select("doc_id", path.alias("path"), words.alias("words"))
    word = lambda i: F.coalesce(F.when(i >= 0, F.get("words", i)), F.lit(""))
    before = lambda i: F.concat_ws(" ", word(i - 2), word(i - 1))
    run = lambda i: (F.length(word(i)) >= 12) & word(i).rlike(CANDIDATE) & word(i).rlike(f"[0-9]|{HEADS}")
    named = lambda i: (
        word(i).rlike(f"{ASSIGNED}(?s:.)") | word(i - 1).rlike("[=:]>?[\"'`]?$") & led(before(i)))
    kept = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: run(i) | named(i))
    places = F.transform(kept, lambda i: F.struct(
        i.alias("at"), word(i).alias("word"), before(i).alias("before"), word(i + 1).alias("after")))
    return rows.select("doc_id", "path", F.monotonically_increasing_id().alias("row"), places.alias("places"))


def led(before: Column) -> Column:
    """Whether the words before end with a naming word and the sign that assigns."""
    return F.right(before, F.lit(REACH)).rlike(f"{ASSIGNED}[\"'`]?$")


def bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, OPENING, ""), CLOSING, "")


def values(rows: DataFrame) -> DataFrame:
    """One row per candidate: its ``value``, and as ``lead`` what stands before it in its word.

    A word gives the runs of key characters in it that have a digit or an issuer's head, and the value
    that a naming word assigns: the rest of the word behind the sign, or the whole word if the sign stands
    before it, without quotes and brackets. Equal values of one word count once; a run inside a longer
    assigned value is a candidate beside it.
    """
    each = rows.select("row", "path", F.explode("places").alias("p")).select("row", "path", "p.*")
    runs = F.filter(
        F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), lambda v: v.rlike(f"[0-9]|{ISSUED}"))
    behind = bare(F.regexp_extract("word", f"{ASSIGNED}((?s:.+))$", 1))
    assigned = F.when(behind != "", behind).when(led(F.col("before")), bare(F.col("word"))).otherwise("")
    found = F.array_distinct(F.concat(runs, F.filter(F.array(assigned), lambda v: v != "")))
    each = each.withColumn("value", F.explode(found))
    lead = F.expr("substring(word, 1, instr(word, value) - 1)")
    return each.select("row", "at", "value", lead.alias("lead"), "before", "after", "path")


def corpus_words(documents: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts: runs of letters in lower case."""
    words = F.split(F.lower(F.col("text").cast("string")), "[^\\p{L}]+")
    each = documents.select(F.explode(words).alias("word")).filter("length(word) >= 2")
    return each.groupBy("word").agg(F.count("*").alias("n"))


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters; none in a text of one character."""
    letters = F.split(text, "")
    pairs = F.greatest(F.size(letters) - 1, F.lit(0))
    return F.zip_with(F.slice(letters, F.lit(1), pairs), F.slice(letters, F.lit(2), pairs), lambda a, b: F.concat(a, b))


def transitions(words: DataFrame) -> DataFrame:
    """``(pair, logp)``: the log-probability of a lower-case letter after another, add-one smoothed.

    There are 676 pairs at most, so the table can be broadcast.
    """
    plain = words.filter(F.col("word").rlike("^[a-z]+$"))
    pairs = plain.select(F.explode(bigrams(F.col("word"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    heads = pairs.groupBy(F.substring("pair", 1, 1).alias("head")).agg(F.sum("n").alias("all"))
    joined = pairs.withColumn("head", F.substring("pair", 1, 1)).join(heads, "head")
    return joined.select("pair", F.log2((F.col("n") + 1) / (F.col("all") + len(LETTERS))).alias("logp"))


def with_features(found: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add the input columns. ``found`` has a unique ``id`` besides the columns of a candidate."""
    lowered = F.lower("value")
    each = found.select("id", F.explode(bigrams(lowered)).alias("pair")).join(F.broadcast(pairs), "pair", "left")
    likely = each.groupBy("id").agg(F.avg(F.coalesce("logp", F.lit(-12.0))).alias("likelihood"))
    runs = found.select("id", F.explode(F.regexp_extract_all(lowered, F.lit("\\p{L}{3,}"), F.lit(0))).alias("word"))
    known = words.filter(F.col("n") >= DICTIONARY_COUNT).select("word")
    covered = runs.join(known, "word", "left_semi").groupBy("id").agg(F.sum(F.length("word")).alias("covered"))
    value, lead, before = F.col("value"), F.col("lead"), F.col("before")
    size = F.length("value")
    share = lambda keep: F.length(F.regexp_replace("value", keep, "")) / size
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        value, "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a"), "[^0Aa]+", "-")
    joined = found.join(likely, "id", "left").join(covered, "id", "left")
    out = {
        "length": size, "digits": share("[^0-9]"), "uppers": share("[^A-Z]"), "lowers": share("[^a-z]"),
        "symbols": share("[A-Za-z0-9]"), "changes": F.length(kinds) / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "likelihood": F.coalesce("likelihood", F.lit(-12.0)), "coverage": F.coalesce("covered", F.lit(0)) / size,
        "named": (lead.rlike(NAMING) | before.rlike(NAMING)).cast("double"),
        "assigned": (lead.rlike("[=:]") | before.rlike("[=:]\\s*$")).cast("double"),
        "quoted": lead.rlike("[\"'`]$").cast("double"), "issued": value.rlike(ISSUED).cast("double"),
        "before_length": F.length("before"), "after_length": F.length("after"),
        "path_keeps": F.coalesce(F.col("path").rlike(KEEPING), F.lit(False)),
        "path_tries": F.coalesce(F.col("path").rlike(TRYING), F.lit(False)),
    }
    return joined.select(*found.columns, *[c.cast("double").alias(k) for k, c in out.items()])


def common_words(words: DataFrame, count: int = COMMON_WORDS) -> DataFrame:
    """``number, common``: the most frequent words of three letters or more, numbered from 0."""
    top = words.filter("length(word) >= 3").orderBy(F.desc("n"), "word").limit(count)
    listed = top.agg(F.array_sort(F.collect_list("word")).alias("listed"))
    return listed.select(F.posexplode("listed").alias("number", "common"))


def generated_findings(words: DataFrame, count: int = GENERATED) -> DataFrame:
    """Labelled findings in the usual forms, written from hashes.

    Half are secrets: keys, short passwords with signs, keys of letters alone and pass phrases. The others are
    numbers, identifiers, paths and names, and behind a naming word the common words of the corpus and placeholders.
    """
    spark = words.sparkSession
    base = spark.range(count, numPartitions=4)

    def dice(name: str, sides: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(name)), F.lit(sides)).cast("int")

    def pick(name: str, items: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in items]), dice(name, len(items)) + 1)

    hexes = F.sha2(F.concat(F.lit("k"), F.col("id").cast("string")).cast("binary"), 512)
    mixed = F.regexp_replace(F.base64(F.unhex(hexes)), "[+/=]", "7")
    cut = lambda c, n: F.substring(c, F.lit(1), n)
    size = F.lit(16) + dice("size", 28)
    sign = pick("sign", ["!", "@", "#", "$", "%", "&", "*", "?"])
    digits = F.translate(hexes, "abcdef", "")
    syllable = lambda i: F.substring(F.translate(
        F.sha2(F.concat_ws("s", "id", F.lit(i)).cast("binary"), 256), "0123456789", "aeiouraeio"), 1, 4)
    key = (
        F.when(dice("kind", 10) == 0, F.concat(F.lit("AKIA"), F.upper(cut(mixed, F.lit(16)))))
        .when(dice("kind", 10) <= 3, cut(hexes, size))
        .when(dice("kind", 10) == 4, F.concat(syllable(1), cut(digits, F.lit(1) + dice("tail", 4)), sign))
        .when(dice("kind", 10) == 5, F.concat(cut(mixed, F.lit(3) + dice("tail", 6)), sign, syllable(1), sign))
        .when(dice("kind", 10) == 6, F.regexp_replace(cut(mixed, size), "[0-9]", "q"))
        .when(dice("kind", 10) == 7, F.concat(syllable(1), syllable(2), syllable(3), syllable(4), syllable(5)))
        .otherwise(cut(mixed, size))
    )
    only_named = dice("kind", 10).between(4, 7)
    other = (
        F.when(dice("kind", 10) == 8, F.coalesce("common", F.lit("the")))
        .when(dice("kind", 10) == 9, pick("given", PLACEHOLDERS))
        .when(dice("kind", 10) == 0, cut(digits, F.lit(12) + dice("size", 8)))
        .when(dice("kind", 10) == 1, F.concat_ws(
            "-", cut(hexes, F.lit(8)), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4)))
        .when(dice("kind", 10) == 2, F.concat_ws("-", F.lit("2021"), F.lit("05"), cut(digits, F.lit(2)), F.lit("report")))
        .when(dice("kind", 10) == 3, F.concat(syllable(1), syllable(2), syllable(3), cut(digits, F.lit(1))))
        .when(dice("kind", 10) == 4, F.concat(syllable(1), F.lit("_"), syllable(2), F.lit("_"), syllable(3), F.lit("2")))
        .when(dice("kind", 10) == 5, F.concat(F.lit("/"), syllable(1), F.lit("/"), syllable(2), F.lit("/v1/"), syllable(3)))
        .when(dice("kind", 10) == 6, hexes.substr(1, 40))
        .otherwise(F.concat(F.upper(syllable(1)), F.lit("-"), cut(digits, F.lit(10))))
    )
    secret = dice("label", 2) == 1
    naming = pick("name", ["password=", "token = \"", "api_key: ", "secret=", "access_key = ", "auth_token=", "pwd="])
    plain = pick("word", ["commit ", "the ", "number ", "see ", "file ", "order: ", "sha256 ", "id=", "und ", "les "])
    context = F.when(secret & (only_named | (dice("bare", 6) > 0)) | ~secret & (dice("kind", 10) >= 8), naming).otherwise(plain)
    spaced = F.concat(plain, context)
    place = F.when(secret, pick("path", ["src", "web", "config/app.env", "deploy/keys"])).otherwise(
        pick("path", ["src", "web", "tests/fixtures", "docs/example"]))
    # at most COMMON_WORDS rows
    numbered = base.withColumn("number", dice("common", COMMON_WORDS)).join(
        F.broadcast(common_words(words)), "number", "left")
    return numbered.select(
        F.col("id"), F.when(secret, key).otherwise(other).alias("value"),
        F.regexp_extract(spaced, "(\\S*)$", 1).alias("lead"),
        F.regexp_replace(F.regexp_replace(spaced, "\\S*$", ""), "\\s+$", "").alias("before"),
        pick("after", ["the", "", "und", "la", "of", ";", "is"]).alias("after"),
        place.alias("path"), secret.cast("int").alias("label"))


def table_findings(found: DataFrame, limit: int = FROM_TABLE) -> DataFrame:
    """Findings of the table whose label is certain: an issuer's head marks a key, digits alone do not
    where no naming word assigns them."""
    named = (F.col("named") > 0) & (F.col("assigned") > 0)
    label = F.when(F.col("value").rlike(ISSUED), 1).when(F.col("value").rlike("^[0-9]+$") & ~named, 0)
    sure = found.withColumn("label", label).filter("label IS NOT NULL")
    return sure.orderBy(F.xxhash64("value", F.lit(5)), "id").limit(limit)


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 13):
    """A random forest over labelled findings with the input columns; None without both labels."""
    kinds = {r["label"] for r in findings.select("label").distinct().collect()}
    if len(kinds) < 2:
        return None
    rows = VectorAssembler(inputCols=INPUTS, outputCol="inputs").transform(findings)
    forest = RandomForestClassifier(
        featuresCol="inputs", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="chances")
    return forest.fit(rows.select("inputs", F.col("label").cast("double").alias("label")))


def scored(found: DataFrame, forest) -> DataFrame:
    rows = VectorAssembler(inputCols=INPUTS, outputCol="inputs").transform(found)
    return forest.transform(rows).withColumn("score", F.get(vector_to_array("chances"), F.lit(1)))


def secret_findings(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Every candidate of the stored ``rows`` of :func:`candidates` with its score."""
    found = stored(values(rows).withColumn("id", F.monotonically_increasing_id()))
    words = stored(corpus_words(documents))
    pairs = stored(transitions(words))
    seen = stored(with_features(found, words, pairs))
    made = stored(generated_findings(words))
    labelled = with_features(made, words, pairs).select("label", *INPUTS).unionByName(
        table_findings(seen).select("label", *INPUTS))
    return scored(seen, train(stored(labelled)))


def scan(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row: n_candidates, n_secrets, the secrets as ``word:value`` by place, and the highest score.

    Rows without candidates have zeros, an empty list and score 0. NULL and empty texts have no
    candidates; repeated rows are each scanned; other columns than source are not read.
    """
    rows = stored(candidates(documents))
    found = secret_findings(documents, rows)
    shown = F.when(F.col("score") >= threshold, F.struct("at", "value", "score"))
    by_row = found.groupBy("row").agg(
        F.count("*").alias("n"), F.max("score").alias("top"), F.array_sort(F.collect_list(shown)).alias("secrets"))
    joined = rows.select("doc_id", "row").join(by_row, "row", "left")
    listed = F.transform("secrets", lambda s: F.concat_ws(":", s.at, s.value))
    return joined.select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_candidates"),
        F.coalesce(F.size("secrets"), F.lit(0)).cast("bigint").alias("n_secrets"),
        F.coalesce(F.array_join(listed, ","), F.lit("")).alias("secrets"),
        F.coalesce("top", F.lit(0.0)).alias("score"))
