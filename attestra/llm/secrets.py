"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything runs as DataFrame expressions and Spark ML: candidates and what stands between them come
from the pattern, features are built-in functions of a candidate and its neighbours, and the forest is
trained from labelled findings. Features: length, runs and shares of character classes, distinct
characters, share that dictionary words cover, path marks, and words nearby.
"""

from __future__ import annotations

import string
from functools import lru_cache

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.common import materialize, set_aside

KEY = r"(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credential|authorization)"
SIGN = r"(?:=>|:=|==?|:)\s{0,3}[\"']?"
SCHEME = r"(?:Bearer|bearer|BEARER|Basic|basic|BASIC)\s{1,3}"
LOGIN = r"://[^\s/:@\"']{0,64}+:"
#: What belongs to a match and not to its value.
ASSIGN = f"^(?:{LOGIN}|{SIGN}(?:{SCHEME})?|{SCHEME})"
PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|xox[abeoprs]-|AIza|eyJ)"
KNOWN_PREFIX = f"^(?:{PREFIX}|-----BEGIN )"
BEGIN = r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,4}PRIVATE KEY(?: BLOCK)?-----"
#: In turn: blocks of private keys, passwords in addresses, values after a sign that follows a name with a key word (DB_PASSWORD=,
#: "api-key":), and, where a word begins, tokens after a scheme or with a known prefix, and 16 characters or more with a digit
#: among them. Each begins with a character that is rare or stands at a word's beginning, so most of a text is passed over quickly.
CANDIDATE = "|".join(
    [
        BEGIN + r"(?:[\s\S]{0,20000}?-----END [A-Z0-9 ]{1,60}+-----|(?:(?:\s|\\[nr]){1,4}+[A-Za-z0-9+/=]{16,}+){0,400}+)",
        LOGIN + r"[^\s/@\"']{3,}+(?=@)",
        r"(?=[=:])(?<=(?i:" + KEY + r"s?(?:[_-]?key|[_-][a-z0-9_-]{1,24})?)[\"']?\s{0,3})" + SIGN + f"(?:{SCHEME})?" + r"[^\s\"']{6,}+",
        r"(?<![A-Za-z0-9+/_-])(?:" + SCHEME + r"(?=[A-Za-z+/_.~-]*+[0-9=])[A-Za-z0-9+/_.~=-]{8,}+"
        "|" + PREFIX + r"[A-Za-z0-9+/_=-]{10,}+(?:\.[A-Za-z0-9+/_=-]{4,}+){0,4}+"
        r"|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+)",
    ]
)
#: Words that names, paths and placeholders are made of; those of the corpus are learned beside them.
DICTIONARY = (
    "access account admin article asset audio backup basic build cache change change class client code common component config content "
    "copy core count data date default demo detail doc download dummy email error event example export false field file final folder font "
    "format function game global group guide handler header help here home html http icon image import index info insert item key label "
    "layout library license link list local login main manager media member menu message method model module name note number object "
    "option order output page param part path person photo picture placeholder plugin post price product profile project public query "
    "range record release report request response result sample script search section select server service session setting shop show "
    "simple size source start static status step store string style submit summary support system table target template test text theme "
    "time title token tool track type unit update upload user value version video view wait week widget window word year your "
    "changed correct credential empty enter expired forgotten hidden incorrect invalid mandatory masked missing needed none null optional passphrase password please redacted required reset secret stored unknown wrong"
).split()
NEAR_KEY = r"(?i)(?:password|passwd|pwd|secret|token|key|credential|auth|bearer)\W{0,4}$"
NEAR_DIGEST = r"(?i)(?:sha\d*|md5|hash|commit|checksum|revision|digest|uuid|guid|build|etag|version|isbn|card|order|phone|serial|image|src)\W{0,4}$"
FEATURES = ("length", "runs", "digits", "uppers", "others", "distinct", "hexadecimal", "only_digits", "dictionary", "slashes", "dashes", "in_path", "assigned", "known_prefix", "near_key", "near_digest")
TREES, DEPTH, LIMIT, SEED, TRAINING_ROWS = 40, 8, 0.5, 7, 8000
#: Documents around whose candidates a word has to stand to be known.
LEAST_DOCUMENTS = 3
MASK = "[SECRET]"


def has_candidate(text: Column) -> Column:
    return F.coalesce(text.rlike(CANDIDATE), F.lit(False))


def text_parts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have candidates, with __found, the candidates in order, and __gaps, what stands around them."""
    some = docs.where(has_candidate(F.col("text")))
    return some.withColumns({"__found": F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), "__gaps": F.split("text", CANDIDATE, -1)})


def candidates(docs: DataFrame) -> DataFrame:
    """One row for each candidate: doc_id, __text (the text's hash), pos, match, value, before and after; written, as they are few.

    Null texts and texts without candidates have none; repeated rows have theirs each.
    """
    parts = text_parts(docs.select("doc_id", "text"))
    each = F.transform(F.col("__found"), lambda m, i: F.struct(m.alias("match"), F.get("__gaps", i).alias("before"), F.get("__gaps", i + 1).alias("after")))
    lead = F.transform("__gaps", lambda g, i: F.length(g) + F.coalesce(F.length(F.get("__found", i - 1)), F.lit(0)))
    rows = parts.select("doc_id", F.xxhash64("text").alias("__text"), F.posexplode(F.arrays_zip(each.alias("c"), lead.alias("lead"))).alias("pos", "x"))
    rows = rows.where("x.c IS NOT NULL").select("doc_id", "__text", "pos", "x.c.match", "x.lead", F.right("x.c.before", F.lit(40)).alias("before"), F.left("x.c.after", F.lit(40)).alias("after"))
    return materialize(with_value(rows), "candidates")


def with_value(found: DataFrame) -> DataFrame:
    return found.withColumn("value", F.regexp_replace("match", ASSIGN, ""))


def pieces_of(c: Column) -> Column:
    """Words of three letters or more, lower-cased; a capital begins a new one."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,}"), F.lit(0)), F.lower))


def learned_words(found: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(word): what stands around the candidates of ``least`` documents or more."""
    words = found.select("doc_id", F.explode(pieces_of(F.concat_ws(" ", "before", "after"))).alias("word")).where("length(word) > 2").distinct()
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def with_known_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with __known: the words of each value that ``words`` has."""
    key = ["doc_id", "__text", "pos"]
    asked = found.select(*key, F.explode(pieces_of(F.col("value"))).alias("word")).distinct().join(words, "word")
    known = asked.groupBy(*key).agg(F.collect_set("word").alias("__known")).withColumnsRenamed({k: f"__k{k}" for k in key})
    same = [found[k].eqNullSafe(known[f"__k{k}"]) for k in key]
    return found.join(known, same, "left").drop(*[f"__k{k}" for k in key])


def with_features(found: DataFrame) -> DataFrame:
    """Adds ``FEATURES`` to rows of match, value, before and after, and __known where words were learned."""
    learned = F.col("__known") if "__known" in found.columns else F.array().cast("array<string>")
    value, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    kinds = F.translate(F.translate(F.translate(value, string.ascii_lowercase, "a" * 26), string.ascii_uppercase, "A" * 26), string.digits, "0" * 10)
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    near = F.concat(F.coalesce("before", F.lit("")), F.expr("left(match, length(match) - length(value))"))
    return found.withColumns(
        {
            "length": F.length(value).cast("double"),
            "runs": F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")) / n,
            "digits": share("[^0-9]"),
            "uppers": share("[^A-Z]"),
            "others": share("[A-Za-z0-9]"),
            "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
            "hexadecimal": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "only_digits": flag(value.rlike("^[0-9-]+$")),
            "dictionary": F.greatest(
                1 - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), "")) / n,
                F.aggregate(F.coalesce(learned, F.array().cast("array<string>")), F.lit(0), lambda total, w: total + F.length(w)) / n,
            ),
            "slashes": F.length(F.regexp_replace(value, "[^/]", "")).cast("double"),
            "dashes": F.length(F.regexp_replace(value, "[^_-]", "")) / n,
            "in_path": flag(F.col("before").rlike(r"(?:[/.\\]|://\S*)$") | F.col("after").rlike(r"^(?:\.[A-Za-z]{1,4}\b|[/\\])")),
            "assigned": flag(F.length("match") > F.length("value")),
            "known_prefix": flag(value.rlike(KNOWN_PREFIX)),
            "near_key": flag(near.rlike(NEAR_KEY)),
            "near_digest": flag(near.rlike(NEAR_DIGEST)),
        }
    )


def shapes(spark: SparkSession, rows: int, pool: int) -> DataFrame:
    """Made-up findings: shape, label, match, before, after. ``pool`` (0 or 1) chooses the half of the words and the hashes they are made of."""
    ids = spark.range(rows).select(F.col("id"), F.sha2(F.concat(F.lit(f"{pool}-"), F.col("id").cast("string")), 512).alias("hex"), F.pmod(F.xxhash64("id", F.lit(pool)), F.lit(1_000_003)).alias("r"))
    hexes, code = F.col("hex"), lambda alphabet, n, at=17: F.translate(F.substring("hex", at, n), "0123456789abcdef", alphabet)
    upper = F.concat(code("ABCDEFGH23456QZK", 9), code("7XWVUTSRPNMLJ489", 7, 40))
    mixed = F.concat(code("aB3dEf7hIjK9mNoP", 18), code("qR5tU1wXyZ0bCd2e", 22, 60))
    words = sorted(set(DICTIONARY))[pool::2]
    word = lambda k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    number = lambda n: F.lpad(F.pmod(F.xxhash64("id", F.lit(99 + pool)), F.lit(10**15)).cast("string"), n, "4")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    uuid = text(F.substring(hexes, 1, 8), "-", F.substring(hexes, 9, 4), "-4", F.substring(hexes, 13, 3), "-a", F.substring(hexes, 17, 3), "-", F.substring(hexes, 21, 12))
    short = F.substring(number(15), 1, 2)
    says = {
        "assigned hexadecimal": (1, text("=", F.substring(hexes, 1, 18)), "and password", " then"),
        "quoted hexadecimal": (1, text('= "', F.substring(hexes, 1, 40)), "so that token ", '" is'),
        "quoted hexadecimal, short": (1, text("= '", F.substring(hexes, 1, 24)), "where api_key ", "' was"),
        "cloud key": (1, text("AKIA", upper), "the ", " was"),
        "repository token": (1, text("ghp_", F.substring(mixed, 1, 36)), "use ", " now"),
        "assigned code": (1, text(": ", mixed), "our secret", "."),
        "quoted code": (1, text("='", F.substring(mixed, 5, 32)), "set api_key", "'"),
        "password with marks": (1, text(": ", code("aB3$Ef7!IjK9mNoP", 12)), "login password", " ok"),
        "bare code": (1, F.substring(mixed, 1, 40), "aws key ", " for"),
        "service key": (1, text("sk-", F.substring(mixed, 1, 32)), "with ", ","),
        "word and number": (1, text("=", word(1), short, "!"), "set DB_PASSWORD", " then"),
        "leet": (1, text(": ", code("Tr0ub4d&3rKm!9xZ", 11)), "our client_secret", " and"),
        "quoted word and number": (1, text(': "', word(1), F.substring(number(15), 1, 3)), '{"password"', '"}'),
        "dashed key": (1, text(": ", F.substring(hexes, 1, 11)), "with api-key", " here"),
        "two words and a digit": (1, text(": ", word(1), F.substring(number(15), 1, 1), word(2)), "the passphrase", " is"),
        "short code": (1, text('= "', code("abcXYZ12!mnoRST9", 9)), "with secret_key ", '" and'),
        "login code": (1, text("://", word(1), ":", code("s3cretpw7kd!9xqa", 8)), "at postgres", "@db/main"),
        "login word and number": (1, text("://root:", word(1), short), "at mysql", "@host"),
        "basic login": (1, text(": Basic ", F.base64(text(word(1), ":", F.substring(hexes, 1, 9)).cast("binary"))), "header Authorization", " sent"),
        "bearer": (1, text("Bearer ", mixed), "with ", " sent"),
        "bot token": (1, text("xoxb-", code("abcdefghijKLMNOP", 24)), "bot ", " and"),
        "key block": (1, text("-----BEGIN RSA PRIVATE KEY-----", F.when(F.col("r") % 2 == 0, text("\n", mixed, mixed, "\n-----END RSA PRIVATE KEY-----")).otherwise("")), "key ", " end"),
        "two words": (0, text(": ", word(1), word(2), ","), "the password", " and"),
        "key name": (0, text(": ", word(1), "-", word(2)), "a secret_name", " is"),
        "quoted name": (0, text(': "', word(1), "_", word(2)), '{"token"', '"}'),
        "sample login": (0, text("://user:", word(1)), "like https", "@example.com"),
        "basic words": (0, text("Basic ", word(1), "-2-", word(2)), "the ", " is"),
        "joined words": (0, text(": ", word(1), word(2)), "put api-key", " here"),
        "one word": (0, text(": ", word(1)), "put password", " here"),
        "card": (0, number(16), "card ", " and"),
        "long number": (0, number(16), "of the ", " then"),
        "uuid": (0, uuid, "id ", " in"),
        "commit": (0, F.substring(hexes, 1, 40), "commit ", " by"),
        "md5": (0, F.substring(hexes, 1, 32), "md5 ", " of"),
        "sha256": (0, F.substring(hexes, 1, 64), "sha256:", " at"),
        "name with number": (0, text(word(1), "_", word(2), "_", word(3), "_", F.substring(F.col("r").cast("string"), 1, 3)), "in ", " is"),
        "capital name": (0, F.upper(text(word(1), "_", word(2), "_", F.substring(F.col("r").cast("string"), 1, 1), "_", word(3))), "set ", "=x"),
        "path": (0, text(word(1), "/", word(2), "/2021/", word(3), "-", word(4)), "see /", ".html"),
        "assigned words": (0, text("=", word(1), word(2)), "with password", " as"),
        "placeholder": (0, text('= "your_', word(1), "_here"), "then token ", '" or'),
        "address part": (0, text(word(1), "-", F.col("r").cast("string"), "-", word(2), "-", word(3)), "https://example.com/", "/"),
    }
    pick = F.pmod(F.col("id"), F.lit(len(says)))
    made = [F.struct(F.lit(name).alias("shape"), F.lit(y).alias("label"), m.alias("match"), F.lit(b).alias("before"), F.lit(a).alias("after")) for name, (y, m, b, a) in says.items()]
    return ids.select(F.element_at(F.array(*made), (pick + 1).cast("int")).alias("x")).select("x.*")


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS, pool: int = 0) -> DataFrame:
    """Made-up findings with their labels: shape, match, before, after, label (1: a secret).

    Secrets in the shapes that leak (assigned passwords and tokens, cloud and service keys), and what such
    patterns also find: digests, ids, numbers, names, paths, versions, placeholders. Findings that a user
    has labelled go to ``train`` in their place.
    """
    return shapes(spark, rows, pool)


def tested_by_shape(spark: SparkSession, held: list[str], rows: int = TRAINING_ROWS) -> DataFrame:
    """(shape, label, n, right): forests are trained without the shapes of ``held`` and tried on them, made of other words."""
    model = train(labelled_findings(spark, rows, 0).where(~F.col("shape").isin(held)))
    tried = predicted(model, with_value(labelled_findings(spark, rows, 1).where(F.col("shape").isin(held))))
    right = (F.col("score") >= LIMIT) == (F.col("label") == 1)
    return tried.groupBy("shape", "label").agg(F.count("*").alias("n"), F.sum(right.cast("long")).alias("right"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """Fits the forest to labelled findings (match, before, after, label)."""
    rows = with_features(with_value(findings))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(rows).select("__features", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction")
    return forest.fit(rows)


def predicted(model: RandomForestClassificationModel, found: DataFrame) -> DataFrame:
    """``found`` with the forest's score."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(with_features(found))
    return model.transform(rows).withColumn("score", vector_to_array("__probability")[1])


@lru_cache(maxsize=1)
def default_model(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest of the made-up findings, trained once for a session."""
    return train(labelled_findings(spark))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, limit: float = LIMIT) -> DataFrame:
    """Candidates of ``docs`` with score (0 to 1) and secret (score of ``limit`` or more).

    Columns: doc_id, __text, pos, lead, match, value, score, secret. See ``candidates`` for odd rows.
    """
    found = candidates(docs)
    scored = predicted(model or default_model(docs.sparkSession), with_known_words(found, learned_words(found)))
    return scored.select("doc_id", "__text", "pos", "lead", "match", "value", "score", (F.col("score") >= limit).alias("secret"))


def findings(docs: DataFrame, model: RandomForestClassificationModel | None = None, limit: float = LIMIT) -> DataFrame:
    """(doc_id, start, length, score, secret) of every candidate value; start in characters from 0.

    Of repeated rows that agree in id and text, each candidate is given once.
    """
    found = scan(docs, model, limit).dropDuplicates(["doc_id", "__text", "pos"])
    ends = F.sum(F.col("lead")).over(Window.partitionBy("doc_id", "__text").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    start = ends + F.length("match") - F.length("value")
    return found.select("doc_id", start.cast("long").alias("start"), F.length("value").cast("long").alias("length"), "score", "secret")


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, limit: float = LIMIT, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret's value replaced by ``mask``; no row goes.

    n_chars, where there, follows a text that changed. Null texts stay null. Other columns of any name stay.
    """
    docs, back = set_aside(docs, ("__found", "__gaps", "__pos", "__text", "__id", "__hash"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    secrets = scan(docs, model, limit).where("secret").groupBy(F.col("doc_id").alias("__id"), F.col("__text").alias("__hash")).agg(F.collect_set("pos").alias("__pos"))
    clean = docs.where(~has_candidate(F.col("text")))
    rest = text_parts(docs).withColumn("__text", F.xxhash64("text"))
    rest = rest.join(secrets, rest["doc_id"].eqNullSafe(secrets["__id"]) & (rest["__text"] == secrets["__hash"]), "left")

    def masked(match: Column, i: Column) -> Column:
        hidden = F.concat(F.regexp_extract(match, ASSIGN, 0), F.lit(mask))
        return F.concat(F.get("__gaps", i), F.when(F.array_contains("__pos", i), hidden).otherwise(match))

    changed = F.col("__pos").isNotNull()
    text = F.concat(F.array_join(F.transform("__found", masked), ""), F.element_at("__gaps", -1))
    rest = rest.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.unionByName(rest.select(*columns)).withColumnsRenamed(back)
