"""Secret scans: pattern candidates, and a random forest that takes the false findings out. DataFrame functions only.

Candidates are runs of 16 or more key characters with a digit among them, with upper case after lower case or with a
key's prefix, values of 8 or more characters assigned to a name such as token or password, passwords of 8 or more
characters in URLs, and private key blocks. An equals sign ends a run but for padding, so NAME=value isn't one candidate. Each
distinct candidate of a text is one finding. The forest sees its length and make-up, its character transitions (mean
log-odds of neighbouring character classes), how much of it dictionary words cover, whether the path is one of tests or
documents, and the words beside it: their form, and the log-odds of the nearest, left and right by themselves, so that
what follows a value can't outweigh the name that it is assigned to. The log-odds are learned from the labelled findings. Each place of a candidate is scored with its own words beside, and the candidate is a secret if
any place is.

The forest is trained on labelled findings: value, the text left and right of it, path and label. Where none are given,
synthetic_findings() makes MADE rows by rule, real keys and the usual false alarms alike.

Texts are searched once; only those with a candidate meet the findings in a join, all others pass by unshuffled.

Defined results: null and empty texts have no findings; null path is empty; a null doc_id is matched like any other;
rows equal in doc_id and text have the same findings and are all masked; an empty table gives an empty table; other
columns are ignored by scan() and kept by mask().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, materialize

#: Rows that synthetic_findings() makes.
MADE = 8000
TREES, DEPTH, SEED = 24, 6, 17
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Characters of text that are seen on the left and on the right.
BESIDE = 48

#: What the usual keys begin with.
_PREFIXES = "AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|npm_|hf_|[sr]k[_-]|xox[a-z]-|eyJ"
#: A run with a digit, one with a lower-case letter somewhere before an upper-case one, or one with a key's prefix at its start or behind a sign.
KEY_RUN = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|[A-Z+/_-]*+[a-z+/_-]++[A-Z]"
    rf"|(?:[A-Za-z+/_-]*[+/_-])?(?:{_PREFIXES}))[A-Za-z0-9+/_-]{{16,}}+(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?"
)
_NAMES = "token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key|client[_-]?key|key"
ASSIGNED = rf"(?i)(?:{_NAMES})[\"']?\s*+[:=]\s*+[\"']?([^\s\"',;<>]{{8,}})"
URL_PASSWORD = r"://[^\s/:@]*+:([^\s/@]{8,}+)@"
BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----[\s\S]*?(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|\z)"
#: Words on the left and on the right whose log-odds count, rows that a word must have in the labelled findings, and words kept.
NEAR_LEFT, NEAR_RIGHT, WORD_ROWS, WORDS = 4, 2, 20, 1000

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "other_share", "class_changes", "distinct_chars", "hex_only", "digits_only", "uuid_shape", "same_run",
    "transitions", "dictionary", "path_doc", "named", "hashed", "assigned", "quoted", "placeholder", "linked", "url_password", "beside_words", "word_odds", "right_odds",
)


def candidates(text: str) -> Column:
    """The distinct candidates of a text, longest first."""
    t = F.col(text)
    keys = F.regexp_extract_all(t, F.lit(KEY_RUN), F.lit(0))
    assigned = F.when(t.rlike("[:=]"), F.regexp_extract_all(t, F.lit(ASSIGNED), F.lit(1)))
    blocks = F.when(t.contains("PRIVATE KEY"), F.regexp_extract_all(t, F.lit(BLOCK), F.lit(0)))
    passwords = F.when(t.contains("://"), F.regexp_extract_all(t, F.lit(URL_PASSWORD), F.lit(1)))
    none = F.array().cast("array<string>")
    found = F.array_distinct(F.concat(*(F.coalesce(c, none) for c in (keys, assigned, passwords, blocks))))
    return F.reverse(F.array_sort(F.transform(found, lambda v: F.struct(F.length(v).alias("n"), v.alias("value")))))["value"]


def beside(docs: DataFrame, path: str = "source", found: str | None = None) -> DataFrame:
    """One row for each place of a candidate in a document: doc_id, hash (of the text), value, path, places, place, left and right.

    found: the column of docs that holds its candidates, where they are known. On the left, three white spaces stand for
    more, so that a name is seen whatever its distance. The text is split at the value. A value has 8 characters at least,
    so BESIDE / 8 + 1 parts on a side hold all that is seen there.
    """
    values = candidates("text") if found is None else F.col(found)
    rows = docs.select("doc_id", F.coalesce(F.col(path), F.lit("")).alias("path"), "text", F.xxhash64("text").alias("hash"), F.explode(values).alias("value"))
    literal = F.regexp_replace("value", "([^A-Za-z0-9])", r"\\$1")
    rows = rows.select("doc_id", "hash", "value", "path", F.split("text", literal, -1).alias("parts"))
    near = BESIDE // 8 + 1
    ends = F.transform("parts", lambda p: F.right(F.regexp_replace(p, r"(\s{3})\s++", "$1"), F.lit(BESIDE))).alias("ends")
    starts = F.transform("parts", lambda p: F.left(p, F.lit(BESIDE))).alias("starts")

    def sides(parts: Column, place: Column) -> Column:
        lefts = F.slice(parts["ends"], F.greatest(F.lit(1), place - near + 1), F.least(F.lit(near), place))
        rights = F.slice(parts["starts"], place + 1, F.lit(near))
        return F.struct(
            place.alias("place"),
            F.right(F.call_function("array_join", lefts, F.right("value", F.lit(BESIDE))), F.lit(BESIDE)).alias("left"),
            F.left(F.call_function("array_join", rights, F.left("value", F.lit(BESIDE))), F.lit(BESIDE)).alias("right"),
        )

    places = F.size("parts") - 1
    # an array of one struct, so that the parts are made once, and only two short strings go on with each place
    seen = F.transform(F.array(F.struct(ends, starts)), lambda parts: F.transform(F.sequence(F.lit(1), places), lambda place: sides(parts, place)))
    return rows.select("doc_id", "hash", "value", "path", places.alias("places"), F.inline(seen[0]))


def _classes(value: str) -> Column:
    """The value with each character as its class: 0 digit, 1 and 2 upper-case vowel and consonant, 3 and 4 lower-case ones, - other."""
    out = F.col(value)
    for chars, mark in (("[^A-Za-z0-9]", "-"), ("[0-9]", "0"), ("[AEIOU]", "1"), ("[A-Z]", "2"), ("[aeiou]", "3"), ("[a-z]", "4")):
        out = F.regexp_replace(out, chars, mark)
    return out


_PAIRS = "transform(sequence(1, greatest(length(classes) - 1, 1)), i -> substring(classes, i, 2))"


def _odds(pairs: DataFrame, prior: int, least: int, most: int) -> dict[str, float]:
    """The log-odds of what pairs (label, key) have in true and in false findings: `most` keys of `least` rows or more."""
    counts = pairs.groupBy("key").agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no"))
    every = Window.partitionBy()  # over the distinct keys of the labelled findings
    odds = ((F.col("yes") + 1) / (F.sum("yes").over(every) + prior)) / ((F.col("no") + 1) / (F.sum("no").over(every) + prior))
    rows = counts.select("key", (F.col("yes") + F.col("no")).alias("n"), F.log(odds).alias("odds")).where(F.col("n") >= least)
    return {r.key: r.odds for r in rows.orderBy(F.desc("n"), "key").limit(most).collect()}


def learn_transitions(rows: DataFrame) -> dict[str, float]:
    """The log-odds of each pair of neighbouring character classes; at most 42 entries."""
    rows = rows.withColumn("classes", _classes("value"))
    return _odds(rows.select("label", F.explode(F.expr(_PAIRS)).alias("key")), 36, 1, 42)


def _near_words() -> tuple[Column, Column]:
    """The nearest words on the left and on the right, in lower case, marked with their side."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[^\s\d\W]{2,}"), F.lit(0))
    left, right = F.slice(F.reverse(words("left")), 1, NEAR_LEFT), F.slice(words("right"), 1, NEAR_RIGHT)
    return F.transform(left, lambda w: F.concat(F.lit("<"), w)), F.transform(right, lambda w: F.concat(F.lit(">"), w))


def learn_words(rows: DataFrame) -> dict[str, float]:
    """The log-odds of the words beside, as "<word" on the left and ">word" on the right; at most WORDS entries."""
    return _odds(rows.select("label", F.explode(F.array_distinct(F.concat(*_near_words()))).alias("key")), WORDS, WORD_ROWS, WORDS)


def _known(odds: dict[str, float]) -> Column:
    """The log-odds as a map of two literals, however many there are; no key has a line break."""
    if not odds:
        return F.create_map().cast("map<string,double>")
    keys, values = (F.split(F.lit("\n".join(x)), "\n") for x in (odds, map(repr, odds.values())))
    return F.map_from_arrays(keys, values.cast("array<double>"))


def describe(rows: DataFrame, odds: dict[str, float], words: dict[str, float], dictionary: DataFrame) -> DataFrame:
    """rows (value, left, right, path and whatever else) with the forest's FEATURES.

    dictionary: one column, word, in lower case. Coverage is the share of the value's characters in letter runs of three
    or more that are words of it.
    """
    v, n = F.col("value"), F.length("value")
    share = lambda chars: F.length(F.regexp_replace(v, f"[^{chars}]", "")) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    left, right = F.lower("left"), F.lower("right")
    known, near = _known(odds), _known(words)
    rows = rows.withColumn("classes", _classes("value")).withColumn("pairs", F.expr(_PAIRS))
    rows = rows.select(
        "*",
        n.cast("double").alias("length"), share("0-9").alias("digit_share"), share("A-Z").alias("upper_share"), share("a-z").alias("lower_share"), (1 - share("A-Za-z0-9")).alias("other_share"),
        (F.length(F.regexp_replace("classes", r"(.)\1*", "x")) / n).alias("class_changes"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("distinct_chars"),
        flag(v.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex_only"), flag(v.rlike(r"^[0-9+-]+$")).alias("digits_only"),
        flag(v.rlike(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("uuid_shape"), flag(v.rlike(r"(.)\1{5}")).alias("same_run"),
        (F.aggregate("pairs", F.lit(0.0), lambda s, p: s + F.coalesce(F.element_at(known, p), F.lit(0.0))) / F.size("pairs")).alias("transitions"),
        flag(F.lower("path").rlike("test|example|sample|doc|fixture|mock|readme")).alias("path_doc"),
        flag(left.rlike(rf"(?:{_NAMES})(?:\W{{0,6}}(?:\w{{0,12}}\W{{1,4}})?|[\"']?\s*[:=]\s*[\"']?)$")).alias("named"),
        flag(left.rlike(r"(?:commit|sha\d*|md5|checksum|digest|etag|revision|rev|hash|uuid|guid|version|integrity)\W{0,4}(?:\w{0,8}\W{1,4})?$")).alias("hashed"),
        flag(left.rlike(r"[:=]\s*[\"']?$")).alias("assigned"), flag(left.rlike("[\"']$") & right.rlike("^[\"']")).alias("quoted"),
        flag(F.lower(v).rlike("example|sample|dummy|your|changeme|placeholder|xxxx|here|12345678")).alias("placeholder"),
        flag(left.rlike(r"(?:https?://|www\.|data:|@)\S*$") | v.rlike("^/")).alias("linked"),
        flag(left.rlike(r"://[^\s/:@]*:$") & right.startswith("@")).alias("url_password"),
        (F.size(F.regexp_extract_all(F.concat_ws(" ", "left", "right"), F.lit(r"[^\s\d\W]{2,}"), F.lit(0))) / 16).alias("beside_words"),
        *(F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at(near, w), F.lit(0.0))).alias(side) for words, side in zip(_near_words(), ("word_odds", "right_odds"), strict=True)),
    )
    runs = rows.select("value", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word")).distinct()
    covered = runs.join(dictionary.select("word").distinct(), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    return rows.join(covered, "value", "left").withColumn("dictionary", F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / n)).drop("covered", "classes", "pairs")


def synthetic_findings(spark: SparkSession, rows: int = MADE) -> DataFrame:
    """Labelled findings made by rule: value, left, right, path, label and kind. Every kind has the same share of rows.

    A third of the paths say nothing; of the others those of false findings are mostly of tests, examples and documents,
    and those of true ones seldom. Half of the rows have words on the right that say nothing, whatever the kind, and half have
    such a word further left: ids, commits and tokens stand beside each other in real texts.
    """
    word = lambda k: f"element_at(array('the', 'of', 'value', 'page', 'report', 'la', 'und', 'que', 'model', 'night', 'house', 'data'), cast(pmod(xxhash64(id, {k}), 12) as int) + 1)"
    text = f"concat({word(1)}, ' ', {word(2)}, ' ')"
    base64 = "replace(replace(base64(unhex(sha2(cast(id as string), 256))), '+', 'Q'), '/', 'z')"
    mixed = f"substring({base64}, 1, 12 + cast(pmod(id, 28) as int))"
    name = f"element_at(array('token', 'api_key', 'secret', 'password', 'auth', 'access_key', 'client_secret'), cast(pmod(xxhash64(id, 3), 7) as int) + 1)"
    letters = "translate(substring(md5(cast(id as string)), 1, 16 + cast(pmod(id, 16) as int)), '0123456789abcdef', 'qwxzkvjbpfgmhtcy')"
    kinds = [  # value, left, right, label
        ("sha1(cast(id as string))", f"concat({text}, {name}, ' = \"')", "'\" and'", 1),
        ("upper(sha1(cast(id as string)))", f"concat(upper({text}), upper({name}), ' = \"')", "'\"!! AND'", 1),
        ("substring(sha2(cast(id as string), 256), 1, 32 + 16 * cast(pmod(id, 3) as int))", f"concat({text}, {name}, ': ')", f"concat(' ', {word(4)})", 1),
        (mixed, f"concat({text}, {name}, '=')", f"concat(' ', {word(4)})", 1),
        (f"concat('AKIA', upper(substring(md5(cast(id as string)), 1, 16)))", f"concat({text})", f"concat(' ', {word(4)})", 1),
        (f"concat('ghp_', substring({base64}, 1, 36))", text, f"concat(' ', {word(4)})", 1),
        (f"concat('sk_live_', substring({base64}, 1, 24))", "'Authorization: Bearer '", f"concat('\\n', {word(4)})", 1),
        ("sha1(cast(id as string))", f"concat({text}, 'commit ')", f"concat(' ', {word(4)})", 0),
        ("sha2(cast(id as string), 256)", f"concat({text}, 'sha256:')", "'  file.tar.gz'", 0),
        ("md5(cast(id as string))", f"concat({text}, 'checksum = \"')", "'\"'", 0),
        ("concat_ws('-', substring(md5(cast(id as string)), 1, 8), substring(md5(cast(id as string)), 9, 4), substring(md5(cast(id as string)), 13, 4), substring(md5(cast(id as string)), 17, 4), substring(md5(cast(id as string)), 21, 12))", f"concat({text}, 'id: ')", f"concat(' ', {word(4)})", 0),
        ("substring(regexp_replace(conv(substring(md5(cast(id as string)), 1, 15), 16, 10), '^0', '1'), 1, 16)", f"concat({text})", f"concat(' ', {word(4)})", 0),
        (f"concat({word(5)}, '-section-', pmod(id, 97), '-', {word(6)}, '_', {word(7)})", text, f"concat(' ', {word(4)})", 0),
        (f"concat('/20', 10 + pmod(id, 15), '/', {word(5)}, '-', {word(6)}, '-', {word(7)})", f"concat({text}, 'https://www.example.com')", f"concat(' ', {word(4)})", 0),
        (f"element_at(array('your_api_key_here_1234', 'xxxxxxxxxxxxxxxxxxx1', 'example-token-0000000', 'changeme12345678', 'dummy_secret_value_1'), cast(pmod(id, 5) as int) + 1)", f"concat({text}, {name}, ' = \"')", "'\"'", 0),
        (f"concat({word(5)}, {word(6)}, {word(7)}, {word(8)}, pmod(id, 100))", f"concat({text})", f"concat(' ', {word(4)})", 0),
        (f"concat({word(5)}, {word(6)}, {word(7)})", f"concat({text}, 'the key: ')", f"concat(' ', {word(4)})", 0),
        ("concat('AKIA', translate(upper(substring(md5(cast(id as string)), 1, 16)), '0123456789', 'GHJKLMNPQR'))", text, f"concat(' ', {word(4)})", 1),
        (f"translate(substring({base64}, 1, 20 + cast(pmod(id, 13) as int)), '0123456789+/=', 'gHjKmNpQrTxYz')", text, f"concat(' ', {word(4)})", 1),
        (f"concat({word(5)}, initcap({word(6)}), initcap({word(7)}), initcap({word(8)}), initcap({word(9)}))", text, f"concat(' ', {word(4)})", 0),
        (f"concat(initcap({word(5)}), '-', initcap({word(6)}), '-', initcap({word(7)}), '_', initcap({word(8)}))", text, f"concat(' ', {word(4)})", 0),
        (f"concat('/', {word(5)}, '/', {word(6)}, initcap({word(7)}), '/', initcap({word(8)}), '/', {word(9)})", text, f"concat(' ', {word(4)})", 0),
        (f"concat({letters}, pmod(id, 10))", text, f"concat(' ', {word(4)})", 1),
        (f"concat({word(5)}, {word(6)}, {word(7)}, {word(8)}, {word(9)}, pmod(id, 10))", text, f"concat(' ', {word(4)})", 0),
        (mixed, f"concat('{{\"', {word(1)}, '\": 1, \"', {name}, '\": \"')", "'\", \"id\": 5'", 1),
        (f"substring({base64}, 1, 40)", f"concat({word(1)}, '\n', upper(concat({word(2)}, '_', {name})), '=')", f"concat('\n', {word(4)})", 1),
        (f"substring({base64}, 1, 9 + cast(pmod(id, 12) as int))", f"concat({text}, element_at(array('postgres', 'mysql', 'https', 'redis'), cast(pmod(xxhash64(id, 10), 4) as int) + 1), '://', {word(3)}, ':')", "'@db.internal/app'", 1),
        ("sha1(cast(id as string))", f"concat('{{\"', {word(1)}, '\": 1, \"commit\": \"')", "'\", \"id\": 5'", 0),
        ("sha1(cast(id as string))", f"concat({word(1)}, '\nGIT_COMMIT=')", f"concat('\n', {word(4)})", 0),
        (f"concat({word(5)}, '-', {word(6)}, '-', pmod(id, 1000), '-', {word(7)})", f"concat({text}, 'https://', {word(3)}, '.example.org/')", f"concat(' ', {word(4)})", 0),
        (f"concat_ws('-', {', '.join(f'substring({letters}, {i}, 4)' for i in (1, 5, 9, 13))})", f"concat({text}, {name}, ': ')", f"concat(' ', {word(4)})", 1),
        (f"concat_ws('-', {word(5)}, {word(6)}, {word(7)}, {word(8)}, {word(9)})", f"concat({text}, {name}, ': ')", f"concat(' ', {word(4)})", 0),
    ]
    pick = lambda i: "CASE " + " ".join(f"WHEN kind = {k} THEN {x[i]}" for k, x in enumerate(kinds)) + " END"
    made = spark.range(0, rows, 1, 4).withColumn("kind", F.expr(f"cast(id % {len(kinds)} as int)"))
    made = made.select("id", "kind", *(F.expr(pick(i)).alias(c) for i, c in enumerate(("value", "left", "right", "label"))))
    beside = "element_at(array('then id', 'id', 'commit', 'checksum', 'token', 'and hash', 'secret', 'version'), cast(pmod(xxhash64(id, {0}), 8) as int) + 1)"
    quote = r"regexp_extract(right, '^[^\w\s]?', 0)"  # what ends the value stays, and all of a URL's host
    right = f"CASE WHEN pmod(xxhash64(id, 30), 2) = 0 AND NOT startswith(right, '@') THEN concat({quote}, ' ', {beside.format(32)}, ' ') ELSE right END"
    left = f"CASE WHEN pmod(xxhash64(id, 31), 2) = 0 THEN concat({beside.format(33)}, ' ', left) ELSE left END"
    docs = "element_at(array('tests/fixtures/keys.txt', 'docs/setup.md', 'examples/demo.py', 'README.md'), cast(pmod(xxhash64(id, 22), 4) as int) + 1)"
    code = "element_at(array('app/config.py', 'deploy/prod.env', 'settings.yaml', 'infra/main.tf'), cast(pmod(xxhash64(id, 23), 4) as int) + 1)"
    path = f"CASE WHEN pmod(xxhash64(id, 20), 3) = 0 THEN concat('src', pmod(id, 20)) WHEN pmod(xxhash64(id, 21), 10) < CASE label WHEN 1 THEN 1 ELSE 7 END THEN {docs} ELSE {code} END"
    return made.select("value", F.expr(left).alias("left"), F.expr(right).alias("right"), F.expr(path).alias("path"), "label", "kind")


@dataclass
class Detector:
    odds: dict[str, float]
    words: dict[str, float]
    forest: RandomForestClassificationModel
    dictionary: DataFrame

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (value, left, right, path and whatever else) with score, the forest's share of votes for a secret, and is_secret."""
        seen = _assembler().transform(describe(rows, self.odds, self.words, self.dictionary))
        scored = self.forest.transform(seen).withColumn("score", vector_to_array("probability")[1])
        return scored.select(*rows.columns, "score", ((F.col("score") >= THRESHOLD) | F.col("value").startswith("-----BEGIN")).alias("is_secret"))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="__features")


def train(findings: DataFrame, dictionary: DataFrame) -> Detector:
    """The detector of labelled findings (value, left, right, path, label)."""
    findings = findings.select("value", "left", "right", "path", "label")
    odds, words = learn_transitions(findings), learn_words(findings)
    seen = _assembler().transform(describe(findings, odds, words, dictionary))
    forest = RandomForestClassifier(labelCol="label", featuresCol="__features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    keys = ["value", "left", "right", "path", "label"]
    rows = seen.coalesce(4).sortWithinPartitions(*keys)  # the forest's draws go by place, so that it doesn't change from run to run
    rows = checkpoint(rows.select("__features", F.col("label").cast("double").alias("label")))  # fit() plans and reads its rows five times
    return Detector(odds, words, forest.fit(rows), dictionary)


def scan(docs: DataFrame, detector: Detector, path: str = "source", found: str | None = None) -> DataFrame:
    """doc_id, hash, value, path, places, left, right, score and is_secret of every finding, as its likeliest place has them."""
    keys = ["doc_id", "hash", "value", "path", "places"]
    best = F.max(F.struct("is_secret", "score", (-F.col("place")).alias("nth"), "left", "right")).alias("best")
    places = materialize(beside(docs, path, found), "places")  # which the score reads twice
    rows = detector.score(places).groupBy(*keys).agg(best, F.count_if(F.col("place") == 1).cast("int").alias("copies"))
    rows = rows.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"))  # equal documents have a row each
    return rows.select(*keys, *(F.col(f"best.{c}").alias(c) for c in ("left", "right", "score", "is_secret")))


def mask(docs: DataFrame, detector: Detector, path: str = "source", by: str = MASK) -> DataFrame:
    """docs with every place of a secret replaced; n_chars, if there, follows the new text."""
    rows = materialize(docs.withColumn("__found", candidates("text")), "candidates")
    has = F.coalesce(F.size("__found") > 0, F.lit(False))
    found = scan(rows.where(has), detector, path, "__found").where("is_secret").select("doc_id", "hash", "value").distinct()
    longest = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(F.length("value").alias("n"), "value")))), lambda x: x["value"])
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).agg(longest.alias("__values"))
    dirty = rows.where(has).withColumn("__own", F.xxhash64("text")).join(found, F.expr("doc_id <=> __id and __own = __hash"), "left")
    text = F.aggregate(F.coalesce("__values", F.array().cast("array<string>")), F.col("text"), lambda t, v: F.replace(t, v, F.lit(by)))
    dirty = dirty.withColumn("text", text)
    if "n_chars" in docs.columns:
        chars = F.when(F.col("__values").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        dirty = dirty.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return rows.where(~has).select(*docs.columns).unionByName(dirty.select(*docs.columns))
