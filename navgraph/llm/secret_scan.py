"""Secret scan with a random forest against false positives; DataFrame and SQL functions only.

One pattern finds candidates (key blocks, signed tokens, values given to names of secrets, long runs with digits); a
forest, trained from labelled findings, decides on each from its length, its character transitions, its coverage by
dictionary words and the path or words around it. A scan is a projection and a filter over the documents: it moves no
rows between machines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.llm.common import checkpointed

#: What a candidate looks like. A value given to a secret's name may hold any marks and no digit; the two
#: short looks behind it spare the long one nearly everywhere. ``=`` belongs to a run as padding at its end only.
NAMES = "secret|token|passw(?:or)?d|passwd|pwd|passphrase|api[_-]?key|apikey|access[_-]?key|auth|credential|private[_-]?key"
GIVEN = "[\\\"']{0,1}\\s{0,2}[:=]\\s{0,2}[\"'`]{0,1}"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    r"|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
    r"|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"
    rf"|(?<=[=:\s\"'`])(?<=[=:]\s{{0,2}}[\"'`]{{0,1}})(?<=(?i:{NAMES}){GIVEN})[^\s\"'`<>()\[\]{{}},;]{{6,}}"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
)
#: Words by which people name secrets, words that name harmless digests, and words of placeholders.
SECRET_WORDS = r"(?i)(secret|token|passw|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private)"
DIGEST_WORDS = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|uuid|guid|revision|version|order|invoice|session id|etag|build)"
PLACEHOLDER_WORDS = r"(?i)(example|sample|dummy|placeholder|changeme|change[_-]me|redacted|required|optional|your[_-]|xxxx|0000|1234567|\*{3,}|\.\.\.|\$\{|os\.|env|none|null|true|false)"
#: A small dictionary whose words, cut out of a candidate, leave what no one would say.
DICTIONARY = (
    r"(?i)(the|and|tion|ing|ment|test|data|file|name|user|page|image|index|main|home|path|list|item|code|type|value|"
    r"table|class|model|build|release|version|config|default|public|static|assets|docs|report|photo|post|news|blog|"
    r"product|category|server|client|service|module|update|backup|archive|final|draft|chapter|section|number|project)"
)
ISSUED = r"^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|eyJ|-----BEGIN)"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ACCOUNT = r"^([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9-]{16,})$"
IDENTIFIER = r"^[A-Za-z]+([._][A-Za-z]+)+$"
CONTEXT = 48
#: Candidates of a text whose places are summed up together; places of a text with n of them take n * BLOCK steps.
BLOCK = 256

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "mark_share", "turns", "vowel_share", "distinct_share", "entropy",
    "hex_only", "dictionary_share", "issued", "uuid", "account", "identifier", "placeholder", "in_path", "in_data", "assigned", "quoted", "named", "near_secret", "near_digest",
)


def _share(x: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(x, pattern, "")) / F.greatest(F.length(x), F.lit(1))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """Add ``FEATURES`` to rows with ``candidate``, ``before`` and ``after`` (up to CONTEXT characters around it)."""
    x, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.greatest(F.length(x), F.lit(1))
    letters = F.split(x, "")
    entropy = F.aggregate(
        F.array_distinct(letters), F.lit(0.0),
        lambda total, c: total + F.when(c == "", 0.0).otherwise((n - F.length(F.replace(x, c, F.lit("")))) / n * F.log2(n / F.greatest(n - F.length(F.replace(x, c, F.lit(""))), F.lit(1)))),
    )
    # a mark between every two neighbours of unlike kinds
    turned = F.regexp_replace(x, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])", "\u0001")
    return found.withColumns({
        "length": F.least(F.length(x), F.lit(200)).cast("double"),
        "digit_share": _share(x, "[^0-9]"),
        "upper_share": _share(x, "[^A-Z]"),
        "lower_share": _share(x, "[^a-z]"),
        "mark_share": _share(x, "[A-Za-z0-9]"),
        "turns": (F.length(turned) - F.length(x)) / n,
        "vowel_share": _share(x, "[^aeiouAEIOU]"),
        "distinct_share": F.size(F.array_distinct(letters)) / n,
        "entropy": entropy,
        "hex_only": _flag(x.rlike("^[0-9a-fA-F]+$")),
        "dictionary_share": 1 - F.length(F.regexp_replace(x, DICTIONARY, "")) / n,
        "issued": _flag(x.rlike(ISSUED)),
        "uuid": _flag(x.rlike(UUID)),
        "account": _flag(x.rlike(ACCOUNT)),
        "identifier": _flag(x.rlike(IDENTIFIER)),
        "placeholder": _flag(x.rlike(PLACEHOLDER_WORDS) | x.rlike(r"(.)\1{5,}")),
        "in_path": _flag(before.rlike(r"(https?:|www\.|/|\\|\.)\S*$") | x.rlike("/.*/.*/") | after.rlike(r"^\.[a-z]{2,4}\b")),
        "in_data": _flag(before.rlike("(?i)(data:|base64|src=|<svg|integrity)")),
        "assigned": _flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": _flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "named": _flag(before.rlike(f"(?i:{NAMES}){GIVEN}$")),
        "near_secret": _flag(before.rlike(SECRET_WORDS)),
        "near_digest": _flag(before.rlike(DIGEST_WORDS)),
    })


def _starts(between: Column, found: Column) -> Column:
    """0-based code points at which the candidates ``found`` start, with the stretches ``between`` them; by blocks of
    candidates, as the array that a fold carries along is copied at each step."""
    lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda x, y: F.struct(F.length(x).cast("long").alias("gap"), F.length(y).cast("long").alias("own")))
    numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    zero, nothing = F.lit(0).cast("long"), F.array().cast("array<long>")
    start = lambda at: F.struct(at.alias("at"), nothing.alias("out"))
    block = lambda j: F.slice(lengths, j * BLOCK + 1, BLOCK)
    sums = F.transform(numbers, lambda j: F.aggregate(block(j), zero, lambda s, x: s + x["gap"] + x["own"]))
    firsts = F.aggregate(sums, start(zero), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    inside = lambda at, j: F.aggregate(block(j), start(at), lambda s, x: F.struct((s["at"] + x["gap"] + x["own"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["gap"])).alias("out")), lambda s: s["out"])
    return F.flatten(F.zip_with(firsts, numbers, inside))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, pos`` (0-based code point), ``candidate``, ``before``, ``after`` and ``text_key`` (hash of the text) for
    every candidate of every whole text."""
    text = F.col(text_col).cast("string")
    hit = docs.select(F.col(id_col), text.alias("__text")).where(F.col("__text").rlike(CANDIDATE))
    # Stretches between candidates and candidates take turns, so a candidate starts where the lengths before it end.
    hit = hit.select(id_col, F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(0)).alias("__found"), F.split("__text", CANDIDATE, -1).alias("__between"), F.xxhash64("__text").alias("text_key"))
    placed = hit.withColumn("__starts", _starts(F.col("__between"), F.col("__found")))
    marked = placed.select(id_col, "text_key", "__starts", "__between", F.posexplode("__found").alias("__k", "candidate"))
    before = F.right(F.get("__between", F.col("__k")), F.lit(CONTEXT))
    after = F.left(F.get("__between", F.col("__k") + 1), F.lit(CONTEXT))
    return marked.select(id_col, F.get("__starts", F.col("__k")).alias("pos"), "candidate", before.alias("before"), after.alias("after"), "text_key")


def labelled_texts(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """``id, text, label``: short texts of a bounded number, made from row numbers, each with one finding.

    Half of the kinds are secrets as issuers format them and people write them, in the places where they leak; half are
    what is mistaken for them: commit hashes, UUIDs, checksums, asset paths, long names with digits, order, card and
    account numbers, image data, placeholders, masked values, variables given to a secret's name.
    """
    i = F.col("id").cast("string")
    hex_ = lambda salt: F.sha2(F.concat(i, F.lit(salt)), 256)
    base64 = lambda salt: F.base64(F.unhex(F.concat(hex_(salt), hex_(salt + "b"))))
    alnum = lambda salt, n: F.substring(F.regexp_replace(base64(salt), "[+/=]", "Q"), 1, n)
    below = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), below(salt, len(of)) + 1)
    name = pick("n", "token", "TOKEN", "api_key", "secret", "password", "auth_token", "access_key", "API_KEY", "client_secret", "passwd")
    join = pick("j", " = \"", "=\"", ": \"", " = '", "=", ": ", " = ")
    prose = pick("w", "see the ", "and of the ", "le de la ", "was then ", "", "der die und ")
    digest = pick("d", "commit ", "sha256: ", "md5 checksum ", "revision ", "etag=\"", "build ", "uuid: ", "order no. ", "session id ")
    folder = pick("f", "https://example.org/static/", "/assets/img/", "src/data/", "docs/archive/", "www.site.net/news/")
    dashed = lambda h: F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    digits = lambda salt, n: F.substring(F.regexp_replace(F.concat(hex_(salt), hex_(salt + "2"), hex_(salt + "3")), "[a-f]", ""), 1, n)
    noun = lambda salt: pick(salt, "hunter", "dragon", "summer", "winter", "monkey", "purple", "coffee", "garden", "silver", "rocket", "planet", "tiger")
    words = F.concat(pick("a", "release", "chapter", "product", "annual_report", "user_manual", "backup"), F.lit("-"), pick("b", "final", "version", "category", "section", "update"), F.lit("-"), digits("v", 6))
    variable = F.concat(pick("va", "next", "request", "get", "self", "config", "user", "args"), pick("vb", "_", ".", "."), pick("vc", "token", "password", "value", "secret", "name", "session"), pick("vd", "", "", "_value", ".text", "_field", ".get"))
    masked = F.when(below("mh", 2) == 0, F.concat(prose, name, join)).otherwise(F.concat(prose, pick("mi", "hook ", "", "use ", "like ", "e.g. ")))
    kinds = [
        (1, F.substring(hex_("k"), 1, 40), F.concat(prose, name, join)),
        (1, F.upper(F.substring(hex_("k2"), 1, 40)), F.concat(prose, name, join)),
        (1, F.left(alnum("a", 40), below("al", 21) + 20), F.concat(prose, name, join)),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(alnum("b", 40), 1, 16))), F.concat(prose, pick("x", "key ", "aws ", "access_key = ", "API_KEY=", ""))),
        (1, F.concat(pick("p", "ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "sk-"), alnum("c", 36)), F.concat(prose, pick("y", "", "use ", "token="))),
        (1, F.substring(hex_("k3"), 1, 64), F.concat(name, join)),
        (1, F.concat(F.lit("eyJ"), alnum("d", 20), F.lit("."), F.lit("eyJ"), alnum("e", 30), F.lit("."), alnum("f", 40)), F.concat(prose, name, join)),
        (1, F.concat(noun("w1"), noun("w2"), noun("w3")), F.concat(prose, pick("pn", "password", "passwd", "pwd", "secret"), join)),
        (1, F.concat(noun("w4"), pick("m1", "!", "#", "@", "_", "."), F.left(alnum("g", 9), below("gl", 5) + 2), pick("m2", "!", "9", "?", "7")), F.concat(prose, pick("pn", "password", "passwd", "pwd", "secret"), join)),
        (0, F.substring(hex_("m"), 1, 40), F.concat(prose, digest)),
        (0, F.substring(hex_("m2"), 1, 32), F.concat(digest, prose)),
        (0, dashed(hex_("u")), F.concat(prose, pick("u", "uuid: ", "id=", "", "request "))),
        (0, words, F.concat(prose, folder)),
        (0, F.concat(words, F.lit("_"), pick("g", "test", "data", "image", "index")), prose),
        (0, digits("c", 16), F.concat(prose, pick("z", "card ", "invoice ", "", "tel "))),
        (0, F.concat(F.lit("your-api-key-"), pick("q", "1234567890", "00000000", "xxxx1")), F.concat(name, join)),
        (0, F.concat(F.lit("example"), F.substring(hex_("o"), 1, 4), F.lit("placeholder")), F.concat(name, join)),
        (0, F.concat(pick("ib", "DE", "FR", "ES", "GB", "NL", "IT"), digits("ib", 20)), F.concat(prose, pick("ic", "IBAN ", "account ", "", "pay to ", "iban: "))),
        (0, F.concat(pick("im", "iVBORw0KGgoAAAANSUhEUg", "R0lGODlhAQABAIAAAAAAAP", "PHN2ZyB4bWxucz0iaHR0cD"), base64("im"), base64("im2")), F.concat(prose, pick("in", "data:image/png;base64,", "src=\"data:image/gif;base64,", "image "))),
        (0, F.concat(pick("mk", "xoxb-", "ghp_", "sk-", "https://hooks.example.com/services/", ""), pick("ml", "****************", "xxxxxxxxxxxxxxxx1", "XXXXXXXXXXXXXXXX9", "<redacted>0000")), masked),
        (0, variable, F.concat(prose, pick("vn", "token", "password", "secret", "auth", "api_key"), pick("vj", " = ", "=", ": "))),
        (0, pick("vw", "required", "optional", "string", "None,", "unknown", "expired", "invalid", "missing"), F.concat(prose, pick("vn", "token", "password", "secret", "auth", "api_key"), F.lit(": "))),
    ]
    closing = F.when(F.col("before").rlike("\"$"), "\" ").when(F.col("before").rlike("'$"), "' ").otherwise(" the ")
    made = []
    for n, (label, value, before) in enumerate(kinds):
        row = spark.range(n, rows, len(kinds)).select("id", F.lit(label).cast("double").alias("label"), before.alias("before"), value.alias("value"))
        made.append(row.select("id", F.concat("before", "value", closing, F.lit("and more words")).alias("text"), "label"))
    return checkpointed(reduce(DataFrame.union, made).coalesce(2))


def labelled_findings(spark: SparkSession, rows: int = 6_000, texts: DataFrame | None = None) -> DataFrame:
    """``candidate, before, after, label`` of the candidates that a scan of labelled texts meets."""
    told = labelled_texts(spark, rows) if texts is None else texts
    return candidates(told.select(F.struct("id", "label").alias("key"), "text"), "key").select("candidate", "before", "after", "key.label")


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(with_features(found))


def fit(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (``candidate, before, after, label``)."""
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__class")
    return forest.fit(_vectors(findings).select("__features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each candidate: ``id_col, pos, length, sha256`` (of the candidate: the secret itself is not passed on),
    ``masked``, ``score``, ``is_secret`` and ``text_key`` (hash of the text).

    Null and empty texts have no candidates; repeated rows give repeated findings; other columns are not read.
    """
    judged = model.transform(_vectors(candidates(docs, id_col, text_col)))
    score = F.round(vector_to_array("__probability")[1], 6)
    return judged.select(
        id_col, "pos", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("sha256"),
        F.concat(F.left("candidate", F.lit(4)), F.lit("...")).alias("masked"), score.alias("score"), (score >= threshold).alias("is_secret"), "text_key",
    )


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the text of every finding that ``is_secret`` replaced by ``mark``; columns unchanged.

    Findings belong to a row by its id (null too) and its text's hash, so rows that share an id keep their own secrets.
    A row without a finding, a null text and an empty table stay as they are.
    """
    own, key, places = "__navgraph_id", "__navgraph_text", "__navgraph_places"
    secret = findings.where("is_secret").groupBy(F.col(id_col).alias(own), F.col("text_key").alias(key)).agg(F.collect_set("pos").alias(places))
    text = F.col(text_col).cast("string")
    joined = docs.join(secret, docs[id_col].eqNullSafe(secret[own]) & (F.xxhash64(docs[text_col].cast("string")) == secret[key]), "left")
    found, between = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    kept = F.zip_with(found, _starts(between, found), lambda x, at: F.when(F.array_contains(places, at), F.lit(mark)).otherwise(x))
    done = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(found)), kept, lambda x, y: F.concat(x, y)), ""), F.element_at(between, -1))
    return joined.withColumn(text_col, F.when(F.col(places).isNull(), F.col(text_col)).otherwise(done)).drop(own, key, places)
