"""Secret scans: a random forest removes false positives among long runs of key characters.

Only DataFrame and SQL functions are used. Candidates and the text around them come from one
split of the text; features are expressions; the dictionary is counted over all documents for
just the letter runs that candidates hold; the forest is trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohlspark.llm.common import LOWER, UPPER, ascii_lower, broadcast_if, fresh, settled, table

#: A run of 16 key characters or more, or one of 8 or more, other marks too, that a key's name and a quote introduce.
#: What stands before a match is looked at one character first, so that most places fail at once.
CANDIDATE = (
    r"""(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"""
    r"""|(?<=["'])(?<=(?i:token|secret|passwd|password|pwd|key)["']?\s{0,2}[:=]{1,2}\s{0,2}["'])[A-Za-z0-9+/_=!@#$%^&*?.-]{8,64}(?=["'])"""
)
#: Characters on either side that the features look at.
AROUND = 48
#: A run of letters is a dictionary word if the documents hold it so many times.
WORD_COUNT = 20
TREES, DEPTH, SEED = 24, 6, 7
#: A text of more than one in HOT of the rows with a candidate is dealt out to SALTS tasks.
HOT, SALTS = 1000, 16
#: At most so many labelled findings train the forest, those whose hashes are least.
SAMPLE = 20_000
MASK = "<SECRET>"

#: Fixed patterns of neighbouring words.
KEYS = r"(?i)(token|secret|passw(or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth(orization)?|bearer|credentials?)[^A-Za-z0-9]{0,8}$"
DIGESTS = r"(?i)(commit|sha-?[0-9]*|md5|checksum|digest|uuid|guid|revision|rev|version|build|serial|isbn|card|phone|order|base64)[^A-Za-z0-9]{0,8}$"
EXAMPLES = r"(?i)(example|sample|dummy|placeholder|your[_-]|changeme|x{6,})"
FEATURES = ["length", "transitions", "digits", "uppers", "marks", "distinct", "hexadecimal", "coverage", "longest_letters", "slashes", "in_path", "key_before", "digest_before", "assigned", "quoted", "placeholder"]


def text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def candidates(docs: DataFrame) -> DataFrame:
    """docs(text) -> text_key, nth, start (code points), candidate, before, after; equal texts give their candidates once."""
    hits = docs.where(F.col("text").rlike(CANDIDATE)).select(text_key(F.col("text")).alias("text_key"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split("text", CANDIDATE, -1).alias("between"))
    right = F.slice("between", F.lit(2), F.size("between"))
    each = hits.select("text_key", F.posexplode(F.arrays_zip("hits", F.col("between").alias("left"), right.alias("right"))).alias("nth", "x"))
    each = each.where(F.col("x.hits").isNotNull()).select(
        "text_key", "nth", F.col("x.hits").alias("candidate"), F.length("x.left").alias("gap"),
        F.right("x.left", F.lit(AROUND)).alias("before"), F.left("x.right", F.lit(AROUND)).alias("after"),
    ).dropDuplicates(["text_key", "nth"])
    upto = Window.partitionBy("text_key").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("candidate")).over(upto) - F.length("candidate")
    return each.select("text_key", "nth", start.cast("long").alias("start"), "candidate", "before", "after")


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def dictionary(docs: DataFrame, runs: DataFrame, least: int = WORD_COUNT, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The distinct runs(run) that all texts hold `least` times or more as words of their own."""
    words = docs.select(F.explode(letter_runs(F.regexp_replace("text", CANDIDATE, " "))).alias("run"))
    small = broadcast_if(runs, 40 * runs.count(), broadcast_bytes)
    return words.join(small, "run", "left_semi").groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("run")


def coverage(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found(candidate, ...) -> candidate, covered: letters of it that stand in dictionary words; one row a candidate."""
    each = found.select("candidate").distinct().select("candidate", F.explode(letter_runs(F.col("candidate"))).alias("run"))
    each = settled(each)
    words = dictionary(docs, settled(each.select("run").distinct())).withColumn("known", F.lit(1))
    return each.join(words, "run", "left").groupBy("candidate").agg(F.sum(F.when(F.col("known").isNotNull(), F.length("run")).otherwise(0)).alias("covered"))


def featured(found: DataFrame, covered: DataFrame) -> DataFrame:
    """found(candidate, before, after, ...) with the columns FEATURES."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.length(c).cast("double")
    classes = F.translate(c, UPPER + LOWER + "0123456789+/_=-", "A" * 26 + "a" * 26 + "0" * 10 + "-" * 5)
    without = lambda pattern: n - F.length(F.regexp_replace(c, pattern, ""))
    yes = lambda e: F.coalesce(e, F.lit(False)).cast("double")
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    made = {
        "length": F.least(n, F.lit(200.0)),
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / n,
        "digits": without("[0-9]+") / n,
        "uppers": without("[A-Z]+") / n,
        "marks": without("[+/_=-]+") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        "hexadecimal": yes(c.rlike("^([0-9a-f]+|[0-9A-F]+)$") & c.rlike("[A-Fa-f]")),
        "coverage": F.coalesce("covered", F.lit(0)) / n,
        "longest_letters": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)) / n,
        "slashes": F.least(without("/+"), F.lit(9.0)),
        "in_path": yes(c.rlike("^/|/[A-Za-z_-]+/|/$") | before.rlike(r"(://|[/\\.~@])[A-Za-z0-9.:]*$") | after.rlike(r"^(\.[A-Za-z]{1,5}\b|[\\:@])")),
        "key_before": yes(before.rlike(KEYS)),
        "digest_before": yes(before.rlike(DIGESTS)),
        "assigned": yes(before.rlike(r"[=:]\s*[\"'`]?$") | c.rlike("^[A-Za-z_-]+=[^=]")),
        "quoted": yes(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "placeholder": yes(c.rlike(EXAMPLES)),
    }
    assert list(made) == FEATURES
    return found.join(covered, "candidate", "left").select(*found.columns, *(v.cast("double").alias(k) for k, v in made.items()))


def labelled_findings(spark: SparkSession, n: int = 8000) -> DataFrame:
    """A made table of labelled findings: candidate, before, after, kind, label. Used where none is given.

    The label says what the string is, not where it stands: keys, passwords and prefixed keys are secrets; digests,
    identifiers, long words, numbers, paths, placeholders and rules are not. Where it stands is drawn apart, from shares that
    differ by kind: most keys stand next to a key's name, but one in eight stands in prose or next to another name; most
    digests stand next to a digest's name or in prose, but one in twenty next to a key's name.
    """
    i = F.col("id")
    draw = lambda k, n: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(n)).cast("int")
    pick = lambda k, *xs: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs)), draw(k, len(xs)) + 1)
    hexa = F.concat(F.md5(F.concat(F.lit("h"), i.cast("string")).cast("binary")), F.sha1(i.cast("string").cast("binary")))
    hexa = F.when(draw("upper", 5) == 0, F.upper(hexa)).otherwise(hexa)
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(hexa, hexa))), "[^A-Za-z0-9+/=]", "")
    plain = F.regexp_replace(mixed, "[+/=]", "")
    cut = lambda s, a, b, k: F.left(s, F.lit(a) + draw(k, b - a + 1))
    syllables = [pick(f"s{k}", "an", "ing", "the", "er", "tion", "re", "st", "un", "ver", "gen", "ado", "que", "eau", "able", "or") for k in range(9)]
    word = F.concat(*syllables)
    number = F.concat(*(draw(f"n{k}", 10).cast("string") for k in range(16)))
    random = pick("random", F.left(hexa, F.lit(32)), F.substring(hexa, 20, 40), hexa)
    kinds = {
        "key": (pick("key", random, cut(mixed, 24, 64, "a"), cut(plain, 20, 44, "b")), 1),
        "prefixed": (pick("prefixed", F.concat(F.lit("AKIA"), F.upper(F.left(plain, F.lit(16)))), F.concat(F.lit("ghp_"), F.left(plain, F.lit(36))), F.concat(F.lit("sk_live_"), F.left(plain, F.lit(24)))), 1),
        "password": (F.concat(cut(plain, 6, 11, "p"), pick("pm", "!", "#7", "_x9", "@1", "2024", "$")), 1),
        "digest": (random, 0),
        "identifier": (pick("id", F.concat_ws("-", *(F.substring(hexa, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), number, F.concat(F.initcap(word), number.substr(1, 2))), 0),
        "words": (pick("words", word, F.concat_ws("_", *syllables[:4]), F.concat_ws("-", *syllables[:5])), 0),
        "path": (F.concat_ws("/", F.lit("usr"), *syllables[:5]), 0),
        "placeholder": (pick("ph", "your_api_key_here", "xxxxxxxxxxxxxxxxxxxx", "EXAMPLE_TOKEN_000000", "changeme_changeme_1", "required", "optional_value", F.repeat(pick("rule", "-", "=", "_"), F.lit(20) + draw("r", 40))), 0),
    }
    name = pick("name", "token", "api_key", "secret", "password", "auth_token", "access key", "private_key", "credentials", "Authorization: Bearer", "client secret", "passwd", "API-KEY", "TOKEN")
    to = pick("to", " = ", "=", ": ", ":", " := ", " ")
    quote = pick("quote", '"', "'", '"', "")
    prose = F.concat(pick("p1", "of the ", "and ", "que la ", "und ", "see "), pick("p2", "inner ", "casa ", "werk ", "other ", ""))
    thing = pick("thing", "commit", "sha1", "sha256", "md5", "checksum", "uuid", "digest", "build", "version", "revision")
    at = draw("place", 40)
    # of forty: so many next to a key's name, then so many in prose; the rest next to a digest's name
    shares = {"key": (35, 3), "prefixed": (24, 12), "password": (40, 0), "digest": (2, 14), "identifier": (1, 30), "words": (2, 38), "path": (1, 37), "placeholder": (20, 20)}
    kind = pick("kind", "key", "key", "key", *kinds)
    by = lambda what: F.coalesce(*(F.when(F.col("kind") == k, F.lit(v) if isinstance(v, int) else v) for k, v in what.items()))
    named, plainly = by({k: v[0] for k, v in shares.items()}), by({k: v[0] + v[1] for k, v in shares.items()})
    mark = F.when(F.col("kind") == "password", '"').otherwise(quote)
    key = F.concat(prose, F.when(F.col("kind") == "password", pick("pw", "password", "passwd", "pwd", "secret", "token")).otherwise(name), F.when(F.col("kind") == "password", pick("pt", " = ", "=", ": ")).otherwise(to), mark)
    return spark.range(n).withColumn("kind", kind).select(
        by({k: v[0] for k, v in kinds.items()}).alias("candidate"),
        F.when(at < named, key).when(at < plainly, prose).otherwise(F.concat(prose, thing, to, quote)).alias("before"),
        F.when(at < named, F.concat(mark, F.lit(" and the"))).when(at < plainly, pick("end", " and", ", the", ".", " of", "\n")).otherwise(F.concat(quote, F.lit(" and the"))).alias("after"),
        "kind", by({k: v[1] for k, v in kinds.items()}).cast("double").alias("label"),
    )


def forest(findings: DataFrame) -> RandomForestClassificationModel:
    """findings(FEATURES, label) -> the forest; trained in one partition so that it is the same every time."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings).select("features", "label", *FEATURES)
    some = settled(rows.orderBy(F.xxhash64(*FEATURES), *FEATURES, "label").limit(SAMPLE).select("features", "label").coalesce(1))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=3, featureSubsetStrategy="onethird").fit(some)


def scored_candidates(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs(text) -> a row for each candidate of each distinct text: text_key, nth, start, candidate, FEATURES, score, secret."""
    labelled = settled(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    found = settled(candidates(docs))
    covered = settled(coverage(found.select("candidate").unionByName(labelled.select("candidate")), docs))
    model = forest(featured(labelled, covered))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(found, covered))
    score = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return model.transform(ready).select("text_key", "nth", "start", "candidate", *FEATURES, score.alias("score"), (score >= 0.5).alias("secret"))


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, end (code points), candidate_sha256, score, secret: a row for
    each candidate of each row of docs.

    labelled(candidate, before, after, label 0/1) trains the forest; without it a made table does. Null,
    empty and clean texts give no rows; repeated rows and null ids give theirs each; columns other
    than doc_id and text are ignored.
    """
    keyed = settled(docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", text_key(F.col("text")).alias("text_key")))
    found = scored_candidates(docs.select("text"), labelled)
    # the texts of very many rows, fewer than HOT of them, meet their candidates in SALTS tasks each
    often = settled(keyed.groupBy("text_key").agg(F.count("*").alias("n")).where(F.col("n") > keyed.count() // HOT).select("text_key", F.lit(True).alias("hot")))
    hot = lambda df: df.join(F.broadcast(often), "text_key", "left")
    dealt = hot(keyed).withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    copies = hot(found).withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return dealt.join(copies, ["text_key", "salt"]).select(
        "doc_id", "start", (F.col("start") + F.length("candidate")).alias("end"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret"
    )


def redacted(docs: DataFrame, labelled: DataFrame | None = None, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """All rows of docs with their secrets replaced by MASK; n_chars, if there, follows the text. Other texts stay as they are."""
    found = scored_candidates(docs.select("text"), labelled)
    key, flags = fresh("text_key", docs), fresh("flags", docs)
    marks = F.transform(F.array_sort(F.collect_list(F.struct("nth", "secret"))), lambda x: x["secret"])
    texts = settled(found.groupBy(F.col("text_key").alias(key)).agg(marks.alias(flags)).where(F.exists(flags, lambda x: x)))
    size = texts.agg(F.sum(F.size(flags) + 64)).first()[0] or 0
    hits = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    masked = F.zip_with(hits, F.col(flags), lambda h, bad: F.when(bad, MASK).otherwise(h))
    pieces = F.flatten(F.zip_with(F.split("text", CANDIDATE, -1), masked, lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
    text = F.when(F.col(flags).isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text"))
    joined = docs.withColumn(key, text_key(F.col("text"))).join(broadcast_if(texts, size, broadcast_bytes), key, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(flags).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select(docs.columns)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
