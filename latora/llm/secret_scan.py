"""Secret scans with a random forest against false positives (DataFrame and SQL functions only).

Candidates are long runs of key-like characters with a digit in them. Each is described by its
length, its changes of character class, how many of its character transitions are common ones,
how much of it dictionary pieces cover, its class shares, signs of a path around it, and the words
before it and after it. A random forest decides which
candidates are secrets. It is trained with Spark ML on labelled findings made from a seed by
SQL functions, and then written out as one SQL expression, so scanning is a projection: no
Python, no shuffle and no explosion of texts into rows.

Defined cases: a null or empty text has no candidates; a candidate or a text of any length is
read whole; repeated rows are scanned alike; an empty table gives no rows; ``scan`` ignores
extra columns and ``redact`` keeps them. Offsets are code points.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "A-Za-z0-9+/_-"
#: A whole run of 12 or more with a digit; begun only at a run's start, so time grows with length.
CANDIDATE = f"(?<![{RUN}])(?=[A-Za-z+/_-]*+[0-9])[{RUN}]{{12,}}+={{0,2}}"
#: From the end of one candidate to the end of the next.
STEP = rf"\G(?s:.*?){CANDIDATE}"
AT_END = f"[{RUN}]++={{0,2}}$"
CONTEXT = 32
#: Candidates whose lengths are added up at once, so that offsets take near linear time.
OFFSETS = 256
PLACEHOLDER = "<SECRET>"
TREES, DEPTH, SEED, EXAMPLES = 15, 6, 6, 6000

# Pieces of words and names that random strings seldom hold.
DICTIONARY = "tion ing the and ent ther that user name test data file index image config example version table page item http html json build release order value group class type time date main core util commit branch module string number token secret password key".split()
TRANSITIONS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
KEY_WORDS = "passw|pwd|secret|token|api.?key|access.?key|credential|auth|bearer"
OTHER_WORDS = "commit|revision|sha-?[0-9]*|md5|checksum|digest|hash|uuid|guid|version|etag|example|sample|invoice|order|isbn|phone|card|id"
PREFIXES = "AKIA|ASIA|ghp_|gho_|glpat-|xox[bp]-|sk_live_|AIza|eyJ"
FEATURES = ("length", "changes", "transitions", "coverage", "digits", "capitals", "path", "key_word", "assigned", "other_word", "key_after", "other_after", "prefix", "uuid", "distinct")


def features(word: Column, before: Column, after: Column) -> list[Column]:
    """The values of ``FEATURES``, as doubles, of a candidate and the text before and after it."""
    low, ahead = F.lower(word), F.lower(before)
    behind = F.lower(F.regexp_extract(after, r"^[^\n.;,]*", 0))  # what follows in its clause
    n = F.length(word).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    classes = F.translate(word, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 5)
    left = F.length(F.regexp_replace(low, "|".join(DICTIONARY), ""))
    return [
        n,
        (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / n,
        F.regexp_count(low, F.lit(f"(?={'|'.join(TRANSITIONS)})")) / n,
        1 - left / n,
        F.length(F.regexp_replace(word, "[^0-9]", "")) / n,
        F.length(F.regexp_replace(word, "[^A-Z]", "")) / n,
        flag(word.rlike("/.*/") | before.rlike(r"(://|[/\\.@])\S*$")),
        flag(ahead.rlike(KEY_WORDS)),
        flag(before.rlike(r"[=:]\s*[\"']?$")),
        flag(ahead.rlike(rf"\b({OTHER_WORDS})\b")),
        flag(behind.rlike(KEY_WORDS)),
        flag(behind.rlike(rf"\b({OTHER_WORDS})\b")),
        flag(word.rlike(f"^({PREFIXES})")),
        flag(word.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        F.size(F.array_distinct(F.split(word, ""))) / n,
    ]


def labelled_findings(spark: SparkSession, n: int = EXAMPLES, seed: int = SEED) -> DataFrame:
    """(before, word, after, label): secrets and look-alikes, every one from a hash of its number."""
    h = lambda k: F.sha2(F.concat_ws("-", "id", F.lit(seed), F.lit(k)), 512)
    pick = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m)).cast("int")
    choose = lambda k, options: F.get(F.array(*map(F.lit, options)), pick(k, len(options)))
    base64 = F.regexp_replace(F.base64(F.unhex(h(1))), "[+/=]", "")
    capitals = F.upper(base64)
    words = F.concat_ws("_", choose(11, DICTIONARY), choose(12, DICTIONARY), choose(13, DICTIONARY), pick(14, 100).cast("string"))
    uuid = F.concat_ws("-", *(F.substring(h(2), a, w) for a, w in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    digits = F.substring(F.translate(h(3), "abcdef", "012345"), F.lit(1), 12 + pick(15, 8))
    prose = choose(20, ["and then some text of it", "the rest of", "in a longer line", "so was that", "", "for this and"])
    ahead = F.concat(prose, F.lit(" "), choose(21, ["password=", "token = \"", "secret: ", "api_key=", "access key ", "Authorization: Bearer ", "pwd: '", "auth_token="]))
    other = F.concat(prose, F.lit(" "), choose(22, ["commit ", "sha256:", "md5 ", "checksum=", "uuid=", "version ", "etag: \"", "digest: ", "hash ", "example ", "revision "]))
    plain = F.concat(prose, F.lit(" "))
    size = 12 + pick(16, 40)
    calm = choose(30, ["", " and more", "\nnext line", "\" then", ", which", " in the log"])
    key_after = choose(31, [" is the password", " as the secret", " (api key)", " for auth"])
    other_after = choose(32, [" (sha256)", " is the commit", " checksum", " as version", " digest"])
    tail = lambda own, foreign: F.when(pick(33, 8) < 2, own).when(pick(33, 8) == 2, foreign).otherwise(calm)
    cases = [
        (1, ahead, F.substring(h(4), F.lit(1), size)),
        (1, ahead, F.substring(base64, F.lit(1), size)),
        (1, F.when(pick(17, 2) == 0, ahead).otherwise(plain), F.concat(F.lit("AKIA"), F.substring(capitals, 1, 16))),
        (1, F.when(pick(17, 2) == 0, ahead).otherwise(plain), F.concat(choose(18, ["ghp_", "gho_", "glpat-", "sk_live_", "AIza", "xoxb-"]), F.substring(base64, 1, 32))),
        (1, plain, F.substring(base64, F.lit(1), size), key_after),
        (0, other, F.substring(h(5), F.lit(1), F.get(F.array(*map(F.lit, [12, 32, 40, 64])), pick(19, 4)))),
        (0, plain, F.substring(h(6), F.lit(1), size)),
        (0, F.when(pick(17, 2) == 0, other).otherwise(plain), uuid),
        (0, F.when(pick(17, 3) == 0, ahead).otherwise(plain), words),
        (0, plain, digits),
        (0, F.when(pick(17, 4) == 0, ahead).otherwise(plain), F.concat(choose(23, ["xxxxxxxxxxxx", "your_token_here_", "changeme_test_", "000000000000", "abcabcabcabc"]), pick(24, 100).cast("string"))),
        (0, F.concat(plain, choose(25, ["https://example.com/", "/usr/lib/", "see docs/", "www.example.org/"])), F.concat_ws("/", choose(26, DICTIONARY), words, F.substring(h(7), 1, 8))),
        (0, plain, F.concat(choose(27, DICTIONARY), choose(28, DICTIONARY), F.lit("-"), digits)),
    ]
    table = spark.range(n, numPartitions=1).withColumn("kind", (F.col("id") % len(cases)).cast("int"))
    case = F.get(F.array(*(F.struct(b.alias("before"), w.alias("word"), (after[0] if after else tail(key_after, other_after) if y else tail(other_after, key_after)).alias("after"), F.lit(y).cast("double").alias("label")) for y, b, w, *after in cases)), F.col("kind"))
    return table.select(case.alias("x")).select("x.before", "x.word", "x.after", "x.label")


def _leaf_or_split(node, depth: int = 0):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _leaf_or_split(node.leftChild()), _leaf_or_split(node.rightChild())


@functools.cache
def _trained(app: str, seed: int) -> tuple:
    spark = SparkSession.active()
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    found = labelled_findings(spark, seed=seed)
    rows = found.select("label", *(c.alias(n) for c, n in zip(features(F.col("word"), F.col("before"), F.col("after")), FEATURES)))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(vectors)
    return tuple(_leaf_or_split(tree._call_java("rootNode")) for tree in model.trees)


def forest(spark: SparkSession, seed: int = SEED) -> tuple:
    """The trained trees, as nested (feature, threshold, left, right) and votes at the leaves."""
    return _trained(spark.sparkContext.applicationId, seed)


def votes(trees: tuple, values: Column) -> Column:
    """The share of trees that vote for a secret, of a struct of features."""

    def tree(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        k, threshold, left, right = node
        return F.when(values[FEATURES[k]] <= threshold, tree(left)).otherwise(tree(right))

    return sum((tree(t) for t in trees[1:]), tree(trees[0])) / len(trees)


def candidates(text: Column, trees: tuple) -> Column:
    """array<struct<step, word, skipped, score>>: each candidate with the text that leads to it."""
    whole = F.coalesce(text, F.lit(""))
    steps = F.regexp_extract_all(whole, F.lit(STEP), F.lit(0))

    def describe(step: Column) -> Column:
        word = F.regexp_extract(step, AT_END, 0)
        return F.struct(step.alias("step"), word.alias("word"), (F.length(step) - F.length(word)).cast("long").alias("skipped"))

    def weigh(x: Column, after: Column) -> Column:
        before = F.substring(x["step"], F.greatest(x["skipped"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(x["skipped"], F.lit(CONTEXT)).cast("int"))
        shape = F.struct(*(c.alias(n) for c, n in zip(features(x["word"], before, after), FEATURES)))
        # an array of one, so that the features are worked out once and not at every split
        score = F.transform(F.array(shape), lambda v: votes(trees, v))[0]
        return F.struct(x["step"].alias("step"), x["word"].alias("word"), x["skipped"].alias("skipped"), score.alias("score"))

    # arrays of one again: the steps and the rest of the text are found once, not for each candidate
    found = F.transform(F.array(F.transform(steps, describe)), lambda xs: F.struct(xs.alias("steps"), F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x["step"])).alias("read")))
    ended = F.transform(found, lambda y: F.struct(y["steps"].alias("steps"), F.substring(whole, y["read"] + 1, F.lit(CONTEXT)).alias("rest")))
    following = lambda y, i: F.coalesce(F.substring(F.get(y["steps"], i + 1)["step"], 1, CONTEXT), y["rest"])
    return F.transform(ended, lambda y: F.transform(y["steps"], lambda x, i: weigh(x, following(y, i))))[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, secrets: start, end, word, score) of every row."""
    trees = forest(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), candidates(F.col(text_col), trees).alias("found"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(x["step"]))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("found") / OFFSETS).cast("int")), lambda k: total(F.slice("found", k * OFFSETS + 1, F.lit(OFFSETS))))
    found = found.withColumn("blocks", blocks)
    numbered = F.transform("found", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    secret = F.filter(numbered, lambda y: y["x"]["score"] > threshold)

    def span(y: Column) -> Column:
        block = F.floor(y["i"] / OFFSETS).cast("int")
        ahead = F.aggregate(F.slice("blocks", F.lit(1), block), F.lit(0).cast("long"), lambda a, n: a + n)
        end = ahead + total(F.slice("found", block * OFFSETS + 1, y["i"] - block * OFFSETS + 1))
        return F.struct((end - F.length(y["x"]["word"])).alias("start"), end.alias("end"), y["x"]["word"].alias("word"), y["x"]["score"].alias("score"))

    marked = found.select("doc_id", F.size("found").cast("long").alias("n_candidates"), F.transform(secret, span).alias("secrets"))
    return marked.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """The documents, all columns kept, with a placeholder for each secret and ``chars_col`` brought up to date."""
    trees = forest(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = docs.select(row, F.col(text_col).alias("text"), candidates(F.col(text_col), trees).alias("found"))
    pieces = F.transform("found", lambda x: F.when(x["score"] > threshold, F.concat(F.substring(x["step"], F.lit(1), x["skipped"].cast("int")), F.lit(PLACEHOLDER))).otherwise(x["step"]))
    read = F.aggregate("found", F.lit(0), lambda a, x: a + F.length(x["step"]))
    text = F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), read + 1, F.length("text")))
    some = F.exists("found", lambda x: x["score"] > threshold)
    changed = found.select("row", some.alias("some"), F.when(some, text).otherwise(F.col("text")).alias("text"))

    def column(c: str) -> Column:
        old = F.col(f"row.`{c}`")
        if c == text_col:
            return F.col("text").alias(c)
        if c == chars_col:
            return F.when(F.col("some"), F.length("text").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return changed.select(*(column(c) for c in docs.columns))
