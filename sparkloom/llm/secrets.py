"""Secret scans: a random forest removes false positives among candidates, in DataFrame operations only.

Candidates are words of MIN_LENGTH characters or more that have a digit or do not look like an
ordinary word; words with a value behind a name of a secret and a sign; and, of any length, the
word after a word that names a secret, with or without a sign between. Each has features: its length and
that of its value, shares of digits, capitals, small letters and distinct characters,
transitions between character classes, hexadecimal or not, coverage by dictionary words,
path-like signs, and whether the words beside it or the key before its equals sign name a
secret or a harmless thing. The forest is trained on labelled findings: the caller's, or
findings made by a fixed rule, LABELLED in number, of real shapes and of usual mistakes.

Defined results: null and empty texts have no candidates; a candidate may be as long as the
text; every occurrence is a finding, so repeated rows repeat them; an empty table gives none;
other columns are ignored. The position of a finding is the number of words before it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH, SHORT = 12, 6
LABELLED = 6000
TREES, DEPTH, SEED, THRESHOLD = 40, 8, 7, 0.5
NAMES = "(?i)(pass(word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer|pwd)"
HARMLESS = "(?i)^(commit|sha1|sha256|md5|checksum|digest|etag|revision|uuid|id|order|invoice|isbn|version|phone|card|number|hash|build)$"
DICTIONARY = "access account admin api array base build button cache change check class client code color column config content count data default demo dev error event example file first form format get hash header home html http image index info input item key label last line link list local login main map message model name new node null number object option order page param password path placeholder port post query read request response result root sample search server service session set size source start state status string style system table test text time title token type update url user value version view web word write xxxx your".split()
FEATURES = ["n_chars", "n_value", "digits", "upper", "lower", "other", "distinct", "changes", "hexadecimal", "covered", "slashes", "dots", "at", "key_names", "before_names", "before_harmless", "after_names", "quoted", "signed", "vowels", "prefixed"]
SYLLABLES = "en er un de te in an ch ge re th ion ing und tion ne or es ment que la el os ado cion heit ver st le sch".split()
#: A word that only joins a name and a value; a word that holds both; letters of a word as prose has them.
SIGN = "^[=:>\"']+$"
HELD = NAMES + "[A-Za-z0-9_.-]*[\"']?[=:]+[^=:].*"
ORDINARY = "^[^\\p{L}]*\\p{L}?[\\p{Ll}'\u2019]{0,23}[^\\p{L}]*$"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word_index, before2, before, word, after), one row for each candidate."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")), " ")
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    long = lambda w: (F.length(w) >= MIN_LENGTH) & w.rlike("[0-9]")
    named = lambda w: (F.length(w) >= SHORT) & w.contains("=") & w.rlike(NAMES)
    keylike = lambda w: (F.length(w) >= MIN_LENGTH) & ~w.rlike(ORDINARY)
    at_ = lambda i: F.when(i >= 0, F.get("words", i)).otherwise(F.lit(""))
    naming = lambda i: at_(i - 1).rlike(NAMES) | (at_(i - 1).rlike(SIGN) & at_(i - 2).rlike(NAMES))
    held = lambda w: w.rlike(HELD)
    after = lambda w, i: w.rlike("[\\p{L}\\p{N}]") & naming(i)
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("word"))), lambda x: long(x["word"]) | named(x["word"]) | keylike(x["word"]) | held(x["word"]) | after(x["word"], x["i"]))
    near = lambda x, k: at_(x["i"] + k) if k < 0 else F.coalesce(F.get("words", x["i"] + k), F.lit(""))
    # the neighbours are taken here, so that no candidate carries its text's words along
    found = F.transform(hits, lambda x: F.struct(x["i"].cast("long").alias("word_index"), near(x, -2).alias("before2"), near(x, -1).alias("before"), x["word"].alias("word"), near(x, 1).alias("after")))
    return split.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


def share(value: Column, pattern: str) -> Column:
    """Characters of the value that match, by its length."""
    return F.length(F.regexp_replace(value, f"[^{pattern}]", "")) / F.greatest(F.length(value), F.lit(1))


def with_features(found: DataFrame) -> DataFrame:
    """Add the value (without key, quotes and end marks) and the FEATURES."""
    closed = F.regexp_replace(F.col("word"), "(?<=.)[\"'][^\\p{L}\\p{N}]*$", "")  # marks behind a closing quote
    bare = F.regexp_replace(closed, "^[\"'(<\\[{]+|[\"')>\\]},;.!?]+$", "")
    key = F.regexp_extract(bare, "^([A-Za-z_.-]{2,40})[=:]", 1)
    value = F.regexp_replace(F.when(key != "", F.substring(bare, F.length(key) + 2, 1 << 30)).otherwise(bare), "^[\"']+", "")
    d = found.withColumn("value", value).withColumn("key", key)
    v = F.col("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "\u0001"), "[A-Z]+", "\u0002"), "[a-z]+", "\u0003"), "[^\u0001\u0002\u0003]+", "\u0004")
    rest = F.regexp_replace(F.lower(v), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    sign = F.regexp_replace(F.col("before"), "[=:\"']+$", "")
    naming = F.when(sign == "", F.regexp_replace(F.col("before2"), "[=:\"']+$", "")).otherwise(sign)
    is_ = lambda c: c.cast("double")
    return d.select(
        *found.columns, "value",
        F.length("word").cast("double").alias("n_chars"), F.length(v).cast("double").alias("n_value"),
        share(v, "0-9").alias("digits"), share(v, "A-Z").alias("upper"), share(v, "a-z").alias("lower"), (1 - share(v, "A-Za-z0-9")).alias("other"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.greatest(F.length(v), F.lit(1))).alias("distinct"),
        (F.greatest(F.length(classes) - 1, F.lit(0)) / F.greatest(F.length(v), F.lit(1))).alias("changes"),
        is_(v.rlike("^[0-9a-f]+$")).alias("hexadecimal"),
        (1 - F.length(rest) / F.greatest(F.length(v), F.lit(1))).alias("covered"),
        (F.length(v) - F.length(F.replace(v, F.lit("/")))).cast("double").alias("slashes"),
        (F.length(v) - F.length(F.replace(v, F.lit(".")))).cast("double").alias("dots"),
        is_(v.contains("@")).alias("at"), is_(F.col("key").rlike(NAMES)).alias("key_names"),
        is_(naming.rlike(NAMES)).alias("before_names"), is_(naming.rlike(HARMLESS)).alias("before_harmless"),
        is_(F.col("after").rlike(NAMES)).alias("after_names"), is_(F.col("word").rlike("^[\"']")).alias("quoted"),
        is_(F.col("before").rlike("[=:][\"']*$")).alias("signed"),
        share(v, "AEIOUYaeiouyÄÖÜäöüÀ-ÆÈ-ÏÒ-ÖÙ-Ýà-æè-ïò-öù-ý").alias("vowels"), is_(v.rlike("^(AKIA|ASIA|AGPA|gh[a-z]_|xox[a-z]-|sk_|glpat-)")).alias("prefixed"),
    )


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """n labelled findings (before2, before, word, after, secret) made by a fixed rule from hashes of 0 to n - 1."""
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    letters = lambda salt, k: F.substring(F.translate(F.base64(F.unhex(h(salt))), "+/=", "aZ9"), 1, k)
    number = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    pick = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), (number(salt, len(xs)) + 1).cast("int"))
    plain = pick("w", "the", "value", "here", "and", "of", "with", "to", "for", "In", "est", "und", "de")
    then = pick("x", "is", "the", "a", "and", "then", "que", "der", "por", ".")
    upper = F.upper(F.substring(letters("u", 32), 1, 16))
    digits = lambda k: F.substring(F.rpad(F.conv(F.substring(h("d"), 1, 15), 16, 10), 24, "3141592653"), 1, k)
    numbered = lambda k: F.concat_ws(".", *(number(f"p{i}", 255).cast("string") for i in range(k)))
    named = pick("n", "password", "token", "secret", "api_key", "passwd", "access_key", "auth_token", "PASSWORD", "pwd")
    safe = pick("s", "commit", "sha256", "md5", "checksum", "etag", "uuid", "revision", "digest", "build")
    hexed = F.substring(h("h"), 1, (16 + 8 * number("k", 7)).cast("int"))
    common = pick("c", *DICTIONARY[:40])
    two = F.concat(common, F.initcap(pick("e", *DICTIONARY[40:80])))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    none = F.lit("")
    spoken = F.concat(*(pick(f"y{i}", *SYLLABLES) for i in range(5)), F.substring(pick("y5", *SYLLABLES), 1, (number("y6", 4)).cast("int")))
    mark = pick("y7", "", ".", ",", "!!", "!", "?", ".!!")
    shouted = F.concat(F.upper(spoken), mark)
    shapes = [
        (1, none, plain, F.concat(pick("a", "AKIA", "ASIA", "AGPA"), upper)),
        (1, none, plain, F.concat(named, F.lit("="), hexed)),
        (1, named, pick("q", "=", ":"), quote(hexed)),
        (1, named, F.lit("="), letters("l", 32)),
        (1, none, F.concat(named, F.lit(":")), letters("m", 28)),
        (1, none, plain, F.concat(pick("g", "ghp_", "xoxb-", "sk_live_", "glpat-"), letters("o", 30))),
        (1, none, plain, F.concat(named, F.lit("="), F.substring(letters("r", 20), 1, 14))),
        (1, none, F.concat(named, F.lit(":")), F.concat(common, number("j", 99).cast("string"))),
        (1, named, pick("q", "=", ":"), F.substring(letters("k", 20), 1, (6 + number("k", 6)).cast("int"))),
        (1, none, plain, F.concat(named, F.lit(":"), F.substring(h("k2"), 1, (5 + number("k", 7)).cast("int")))),
        (1, none, plain, F.concat(pick("a", "AKIA", "ASIA", "AGPA"), F.translate(upper, "0123456789", "QWERTZPLKJ"))),
        (1, none, plain, F.translate(letters("o2", 36), "0123456789", "qXvTzPkJwR")),
        (1, none, F.concat(named, F.lit(":")), F.translate(F.substring(letters("r2", 30), 1, 18), "0123456789", "qXvTzPkJwR")),
        (0, F.upper(plain), F.concat(F.upper(plain), mark), shouted),
        (0, none, plain, F.concat(spoken, pick("y8", "-", "_", "/", ".", "'", ","), pick("y9", *SYLLABLES), mark)),
        (0, none, plain, F.concat(F.initcap(spoken), F.initcap(pick("y9", *SYLLABLES)), mark)),
        (0, none, named, F.concat(F.substring(spoken, 1, (4 + number("z2", 6)).cast("int")), mark)),
        (0, none, named, pick("c2", *DICTIONARY[40:])),
        (0, none, named, plain),
        (0, none, plain, F.concat(two, F.initcap(pick("e2", *DICTIONARY[20:60])))),
        (0, none, plain, F.concat(F.upper(common), F.lit("_"), F.upper(pick("e2", *DICTIONARY[20:60])))),
        (0, none, plain, F.concat(F.lit("https://example.com/"), common, F.lit("/"), two)),
        (0, none, F.concat(named, F.lit(":")), pick("v2", "changeme", "example", "placeholder", "xxxxxxxx", "your_password", "null", "string")),
        (0, none, safe, hexed),
        (0, safe, F.lit("="), quote(hexed)),
        (0, none, plain, digits(16)),
        (0, none, plain, F.concat(F.lit("555-"), digits(8))),
        (0, none, plain, numbered(4)),
        (0, none, plain, F.concat(F.substring(h("f"), 1, 6), F.lit(".17@mail"), number("t", 9).cast("string"), F.lit(".example.com"))),
        (0, none, plain, F.concat(F.lit("https://example.com/"), common, F.lit("/"), two, F.lit("/"), number("y", 9999).cast("string"))),
        (0, none, plain, F.concat(two, number("z", 9999).cast("string"))),
        (0, none, plain, F.concat(named, F.lit("="), pick("v", "changeme1", "example1234", "your_password1", "xxxxxxxx0", "placeholder9"))),
        (0, none, plain, F.concat(F.lit("/usr/lib/"), common, F.lit("/"), two, F.lit("2.so"))),
        (0, none, plain, F.concat_ws("-", *(F.substring(h("i"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))),
        (0, none, plain, F.concat(common, F.lit("="), number("b", 99999999).cast("string"))),
        (0, named, plain, F.concat(two, F.lit("_2024_"), common)),
    ]
    kind = F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(len(shapes)))
    rows = F.array(*(F.struct(b2.alias("before2"), b.alias("before"), w.alias("word"), then.alias("after"), F.lit(float(y)).alias("secret")) for y, b2, b, w in shapes))
    return spark.range(n, numPartitions=2).select(F.get(rows, kind.cast("int")).alias("r")).select("r.*")


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """labelled: before2, before, word, after, secret (0 or 1)."""
    rows = assembled(with_features(labelled))
    return RandomForestClassifier(featuresCol="features", labelCol="secret", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, word_index, n_chars, value_sha256, score, is_secret."""
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    scored = model.transform(assembled(with_features(candidates(docs, id_col, text_col))))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 9)
    return scored.select("doc_id", "word_index", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), score.alias("score"), (score >= THRESHOLD).alias("is_secret"))
