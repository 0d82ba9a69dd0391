"""Secret scan with a random forest against false findings, in DataFrame code only.

Patterns name candidates: a value that is assigned to a telling word or follows it
as an option, in a sentence or as an element, the password of an address's user, a
long run of letters and digits that has a digit, or a private key block.  A random
forest on length, character transitions, dictionary coverage, path and
neighbouring words then decides.  It is trained on labelled findings: snippets
of known kind, secret or not, set between words of a bounded sample of the
corpus and found again by the same patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# The words, patterns and snippets of the scan.
TELLING = r"(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth[_-]?key|private[_-]?key|credential)"
#: What opens a key block; no other value runs into it.
BEGIN = r"-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY"
#: A whole block, with headers, real or literal line ends, up to its END line; it holds no other run of five dashes.
BLOCK = rf"{BEGIN}(?: BLOCK)?-----(?![^-]{{0,15}}-----END)(?:[^-]++|-(?!----))*+-----END (?:[A-Z0-9]++ )*?PRIVATE KEY(?: BLOCK)?-----"
RUN = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?:[A-Za-z0-9+/_=]|(?!{BEGIN})-){{16,}}+"
#: A telling word; its first letter is looked at before the words are tried.
HEAD = rf"(?=[acpstACPST])(?i:{TELLING})"
#: What stands between it and the value: of an assignment, and of a sentence that has a digit in the value.
ASSIGN = r"[\"']?[ \t]*+(?:=>|:=|[:=])[ \t]*+[\"'`]?"
SAID = r"[ \t]++(?:(?:is|was)[ \t]++)?+"
#: What an address's user is set between.
USER = r"://[^\s/:@\"'<>]*+:"
PATTERN = (
    rf"{BLOCK}|{HEAD}(?:{ASSIGN}(?:{BLOCK}|(?:[^\s\"'`,;<>-]|(?!{BEGIN})-){{8,}}+)|>[^\s<>]{{4,}}+(?=</)|{SAID}(?![-=:])(?=[^\s0-9]*+[0-9])[^\s\"'`,;<>]{{6,}}+)"
    rf"|(?<=-){HEAD}[ \t]++(?![-=:])[^\s\"'`,;<>]{{6,}}+|{USER}[^\s/@\"'<>]{{4,}}+(?=@)|{RUN}"
)
PREFIX = rf"^(?:{HEAD}(?:{ASSIGN}|>|{SAID})|{USER})"
NEAR_GOOD = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private)"
NEAR_BAD = r"(?i)(commit|sha-?(1|256|512)?|md5|checksum|digest|hash|etag|uuid|guid|revision|build|version|isbn|order|phone|card|account|serial|integrity|example|placeholder|dummy)"
DICTIONARY = (
    "password secret token example sample test demo dummy placeholder changeme your here insert replace none null true false default value string user name admin login access private public key "
    "http https www com org net html index static assets image images file files data node version release build module package import export function class return config server client local host "
    "the and for with this that from have are was not you all can has will one about they der die und das ist nicht ein eine les des est que pour dans une con los las del por una"
).split()
SECRET_SNIPPETS = [
    ('token = "', "hex40", '"'),
    ("api_key: ", "mixed32", ""),
    ("password=", "pass12", ""),
    ("secret = '", "mixed40", "'"),
    ("aws key AKIA", "upper16", " used"),
    ("ghp_", "mixed36", ""),
    ("Authorization: Bearer ", "mixed48", ""),
    ('"access_key" : "', "mixed40", '"'),
    ("token=", "hex32", "&page=1"),
    ('secret := "', "hex64", '"'),
    ("client_secret=", "mixed24", ""),
    ("DB_PASSWORD: ", "pass16", ""),
    ('"apiKey": "', "mixed32", '",'),
    ("export AUTH_KEY='", "hex48", "'"),
    ("sk_live_", "mixed24", ""),
    ("private_token: ", "mixed20", ""),
    ("credential => `", "pass20", "`"),
    ("passwd = ", "pass10", ";"),
    ("password     = ", "pass12", ""),
    ("mysql://root:", "pass12", "@db.local/app"),
    ("--password ", "pass12", " --verbose"),
    ("<password>", "pass12", "</password>"),
    ("the password is ", "pass10", " for now"),
    ("the new secret is ", "mixed32", " for you"),
    ("auth with key ", "hex32", ""),
]
OTHER_SNIPPETS = [
    ("commit ", "hex40", ""),
    ("sha256: ", "hex64", ""),
    ("md5 = ", "hex32", ""),
    ("uuid ", "uuid", ""),
    ("/static/assets/", "hex20", ".js"),
    ("https://www.example.com/images/", "hex32", "/index.html"),
    ("card ", "digits16", ""),
    ("order ", "digits20", ""),
    ('password = "', "holder", '"'),
    ("token: ", "words", ""),
    ("file_", "snake", ".html"),
    ("checksum=", "hex40", ""),
    ("", "digits16", ""),
    ("and ", "digits18", ","),
    ('etag: "', "hex32", '"'),
    ("trace_id=", "hex32", ""),
    ('integrity="sha384-', "mixed64", '"'),
    ("data:image/png;base64,", "mixed48", ""),
    ("api_key = ", "call", ""),
    ("secret: ", "holder", ""),
    ("token = ", "call", ";"),
    ("tree/", "hex40", "/src"),
    ("https://user:", "holder", "@www.example.com/"),
    ("--password ", "call", " --verbose"),
    ("<token>", "holder", "</token>"),
    ("the token was ", "words", " before"),
    ("secret ", "snake", " of"),
    ("id ", "uuid", " of"),
    ("revision ", "hex24", ""),
    ("account ", "digits22", ""),
    ("the ", "snake", " of"),
]
FEATURES = [
    "length", "distinct", "digits", "uppers", "vowels", "hexes", "changes", "longest_word", "dictionary",
    "slashes", "marks", "after_path", "before_path", "assigned", "quoted", "near_good", "near_bad",
]


#: Tasks that make and search the training texts.
TASKS = 16


def share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def candidates(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep, start, value`` and the features for each candidate in ``text``.

    ``start`` counts characters from 0.  What stands between candidates gives
    their places and neighbours, so nothing is searched twice.
    """
    d = texts.withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).filter(F.size("found") > 0)
    d = d.withColumn("gaps", F.split("text", PATTERN))
    d = d.select(
        *keep,
        F.posexplode(F.arrays_zip("found", F.slice("gaps", F.lit(1), F.size("found")).alias("before"), F.slice("gaps", F.lit(2), F.size("found")).alias("after"), starts("gaps", "found").alias("at"))).alias("n", "c"),
    )
    value = F.regexp_replace("c.found", PREFIX, "")
    d = d.select(
        *keep,
        (F.col("c.at") + F.length("c.found") - F.length(value)).cast("long").alias("start"),
        value.alias("value"),
        F.concat(F.right("c.before", F.lit(48)), F.substr("c.found", F.lit(1), F.length("c.found") - F.length(value))).alias("before"),
        F.left("c.after", F.lit(24)).alias("after"),
    )
    return features(d)


def starts(gaps: str, found: str) -> Column:
    """Where each candidate begins: what the gaps and candidates before it take."""
    sizes = F.zip_with(F.transform(gaps, F.length), F.transform(found, F.length), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    empty = F.array().cast("array<int>")
    run = F.aggregate(
        F.filter(sizes, lambda x: x["b"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda s, x: F.struct((s["at"] + x["a"] + x["b"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["a"])).alias("out")),
    )
    return run["out"]


def features(d: DataFrame) -> DataFrame:
    v, low = F.col("value"), F.lower("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    changes = F.regexp_count(kinds, F.lit("a(?=[^a])|B(?=[^B])|0(?=[^0])|[^aB0](?=[aB0])"))
    longest = F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), F.length))
    covered = F.length(v) - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    number = {
        "length": F.length(v),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        "digits": share(v, "[0-9]"),
        "uppers": share(v, "[A-Z]"),
        "vowels": share(low, "[aeiou]"),
        "hexes": share(low, "[0-9a-f]"),
        "changes": changes / F.length(v),
        "longest_word": longest / F.length(v),
        "dictionary": covered / F.length(v),
        "slashes": share(v, "/"),
        "marks": share(v, r"[^A-Za-z0-9]"),
        "after_path": F.when(F.col("before").rlike(r"[/.@#][A-Za-z0-9_-]{0,16}$|https?:\S*$"), 1.0).otherwise(0.0),
        "before_path": F.when(F.col("after").rlike(r"^(/|\.[a-z]{2,4}\b)"), 1.0).otherwise(0.0),
        "assigned": F.when(F.col("before").rlike(r"(=>|:=|[:=])\s*+[\"'`]?$|<[A-Za-z_-]+>$"), 1.0).otherwise(0.0),
        "quoted": F.when(F.col("before").rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]"), 1.0).otherwise(0.0),
        "near_good": F.when(F.right("before", F.lit(32)).rlike(NEAR_GOOD), 1.0).otherwise(0.0),
        "near_bad": F.when(F.right("before", F.lit(32)).rlike(NEAR_BAD), 1.0).otherwise(0.0),
    }
    return d.select("*", *[F.coalesce(number[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES])


def labelled(docs: DataFrame, rows: int = 1200) -> DataFrame:
    """Training texts ``id, text, planted, label`` from ``rows`` documents with text, by hash.

    The bound is a parameter.  Each sampled text lends words for both sides of a
    snippet whose value comes from digests of the text, so nothing is random and
    every secret is different.
    """
    filled = docs.filter(F.col("text") != "")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    most = int((1 << 30) * min(1.0, 2 * rows / max(1, filled.count())))
    # twice as many as asked for pass the hash; the first of these are the same ones in every run
    base = filled.select("doc_id", "text", place.alias("place")).filter(F.col("place") < most)
    base = base.select("place", F.sha2(F.concat_ws(" ", F.col("doc_id").cast("string"), "text"), 256).alias("id"), F.substr("text", F.lit(1), F.lit(160)).alias("lead"))
    base = base.orderBy("place", "id").limit(rows).repartition(TASKS, "id")
    base = base.select("id", F.regexp_replace("lead", PATTERN, " ").alias("lead"))

    def value(kind: str, salt: str) -> Column:
        one = F.sha2(F.concat("id", F.lit(salt)), 256)
        mixed = F.regexp_replace(F.concat(F.base64(F.unhex(one)), F.base64(F.unhex(F.sha2(one, 256)))), "[+/=]", "x")
        digits = F.regexp_replace(F.concat(one, F.sha2(one, 256)), "[a-f]", "")
        words = F.filter(F.split(F.lower("lead"), "[^a-z]+"), lambda w: F.length(w) > 3)
        if kind == "uuid":
            return F.concat_ws("-", *[F.substr(one, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        if kind == "holder":
            options = ["changeme", "your_token_here", "xxxxxxxxxxxx", "example-password", "password123", "insert-your-secret-here", "************", "<password-here>"]
            return F.get(F.lit(options), F.pmod(F.xxhash64(one), F.lit(len(options))).cast("int"))
        if kind == "words":
            return F.concat(F.array_join(F.slice(words, 1, 3), "-"), F.lit("-value"))
        if kind == "snake":
            return F.concat(F.array_join(F.slice(words, 1, 3), "_"), F.lit("_version_"), F.substr(digits, F.lit(1), F.lit(2)))
        if kind == "call":
            options = ['os.environ["SERVICE_TOKEN"]', "getenv(TOKEN_NAME)", "config.get_secret(name)", "${SERVICE_API_KEY}", "{{secrets.API_KEY}}", "generate_token(user)", "request.headers.get(token)"]
            return F.get(F.lit(options), F.pmod(F.xxhash64(one), F.lit(len(options))).cast("int"))
        if kind.startswith("pass"):
            return F.concat(F.substr(mixed, F.lit(1), F.lit(int(kind[4:]) // 2)), F.lit("!"), F.substr(mixed, F.lit(20), F.lit(int(kind[4:]) - int(kind[4:]) // 2 - 1)))
        name, size = kind.rstrip("0123456789"), int(kind[len(kind.rstrip("0123456789")) :])
        return F.substr({"hex": one, "mixed": mixed, "upper": F.upper(mixed), "digits": digits}[name], F.lit(1), F.lit(size))

    each = [
        F.struct(F.lit(float(label)).alias("label"), F.lit(before).alias("before"), value(kind, f"{label}{i}").alias("planted"), F.lit(after).alias("after"))
        for label, snippets in ((1, SECRET_SNIPPETS), (0, OTHER_SNIPPETS))
        for i, (before, kind, after) in enumerate(snippets)
    ]
    text = F.concat(F.substr("lead", F.lit(1), F.lit(80)), F.lit(" "), F.col("s.before"), F.col("s.planted"), F.col("s.after"), F.lit(" "), F.substr("lead", F.lit(81), F.lit(80)))
    return base.select("id", "lead", F.explode(F.array(*each)).alias("s")).select("id", text.alias("text"), F.col("s.planted").alias("planted"), F.col("s.label").alias("label"))


def fit(docs: DataFrame, rows: int = 1200, trees: int = 24, depth: int = 8):
    """The forest, or None if no document has text: then there is nothing to judge either."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    found = candidates(labelled(docs, rows), "planted", "label").filter(F.expr("contains(value, planted) or contains(planted, value)"))
    found = stage(found.select("label", *FEATURES), "secret-training")
    kinds = found.select("label").distinct().count()
    if kinds < 2:
        if kinds or docs.filter(F.col("text") != "").head(1):
            raise ValueError("no findings of both kinds to learn from")
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, labelCol="label", featuresCol="features", maxMemoryInMB=64)
    return forest.fit(vectors.transform(found))


def scan(docs: DataFrame, threshold: float = 0.5, rows: int = 1200, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each candidate of each text: place, value, features, verdict.

    Null and empty texts have no candidates; null ids are kept; a repeated row
    gives its findings again; no rows give no rows.  Other columns are ignored.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = list(docs.columns)
    text = docs.select(*[F.col(k) for k in keep], F.col("text").cast("string").alias("text"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id") if "doc_id" in names else F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(plain, rows)
    found = candidates(text, *keep)
    if model is None:
        scored = found.withColumn("score", F.lit(0.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        scored = model.transform(vectors).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    block = F.col("value").startswith("-----BEGIN")
    return scored.select(
        *keep,
        "start",
        F.length("value").cast("long").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        "score",
        (block | (F.col("score") >= threshold)).alias("is_secret"),
        *FEATURES[1:],
    )


#: Documents with secrets whose spans may be sent to every executor (some 100 bytes each).
BROADCAST_ROWS = 200_000


def redact(docs: DataFrame, mark: str = "[SECRET]", threshold: float = 0.5, rows: int = 1200) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; ``n_chars``, if there, follows.

    Rows are matched by doc_id and text, so rows with one id keep their own texts.
    """
    keyed = docs.withColumn("_secret_text", F.xxhash64("text"))
    found = scan(keyed, threshold, rows, keep=("doc_id", "_secret_text")).filter("is_secret")
    spans = found.groupBy("doc_id", "_secret_text").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("_secret_spans"))
    spans = stage(spans.withColumnsRenamed({"doc_id": "_secret_doc", "_secret_text": "_secret_key"}), "secret-spans")
    side = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans
    both = keyed.join(side, keyed["doc_id"].eqNullSafe(F.col("_secret_doc")) & (keyed["_secret_text"] == F.col("_secret_key")), "left")
    cut = F.aggregate(
        "_secret_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            (x["start"] + x["length"]).alias("at"),
            F.concat(s["out"], F.substr("text", (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark)).alias("out"),
        ),
    )
    clean = F.concat(cut["out"], F.substr("text", (cut["at"] + 1).cast("int"), F.length("text")))
    both = both.withColumn("text", F.when(F.col("_secret_spans").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("_secret_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return both.select(*docs.columns)
