"""Secrets in texts, in column expressions and MLlib only.

Patterns propose candidates: values that are assigned to a name like ``password``, and long runs of letters and digits. A
random forest then removes false positives. It sees the candidate's length and kinds of characters, how usual its letter
transitions are in the corpus, how much of it are words of the corpus (dictionary coverage), the path of the document,
and the words around it.

Dictionary and transitions come from the words of all documents. The forest is fitted to labelled findings: rows of a
text that holds one candidate, its path, and whether it is a secret.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.llm.words import let
from tripspark.session import materialize

_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth"
_ASSIGNED = rf"(?i:(?:{_NAMES})[\"']?\s{{0,2}}(?:=>|:=|=|:)\s{{0,2}}[\"']?)"
#: A candidate: a value after a name of a secret, or a run of 16 characters and more.
CANDIDATE = rf"{_ASSIGNED}[^\s\"'`<>,;]{{6,}}+|[A-Za-z0-9+/_=-]{{16,}}+"
MASK = "[SECRET]"
#: Characters kept on each side of a candidate as its neighbourhood.
NEAR = 80
#: Occurrences that make a word of the corpus a dictionary word.
LEAST_COUNT = 5
#: Documents from which labelled findings are made, and the share of trees that must agree.
LABEL_DOCUMENTS = 1500
#: Places in which each document has each shape of findings.
PLACES_EACH = 4
THRESHOLD = 0.5
TREES, DEPTH, SEED = 40, 8, 7

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_EXAMPLE = "(?i)example|sample|dummy|placeholder|your|test|fake|demo|xxx|changeme"
#: Whole words of a path, or just before a value, that say that the value is for show.
_FOR_SHOW = r"(?<![A-Za-z])(?i:examples?|samples?|dummy|placeholders?|tests?|fixtures?|fake|demos?|mocks?)(?![A-Za-z])"
#: Names of digests that are no secrets, before a value or at its start.
_DIGEST_NAMES = r"(?<![A-Za-z])(?i:commit|revision|checksum|digest|etag|integrity|md5|sha-?(?:1|256|384|512)|git)"
FEATURES = (
    "length digits uppers lowers marks distinct switches longest_run transitions coverage longest_word named quoted "
    "path_depth path_example value_example near_example near_name near_digest near_digits"
).split()


def _key() -> Column:
    """Names a document by id and text, so that rows that repeat either are told apart or treated alike."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5("text"))


def candidates(docs: DataFrame, every: bool = False) -> DataFrame:
    """Per candidate of ``docs`` (doc_id, text, path): key, doc_id, path, number, start, value, head, left and right.

    ``head`` is the assignment before the value. Texts are split once at all candidates, so the pieces between them give
    places and neighbourhoods. Runs that have neither a name before them nor a digit are listed with ``every`` only; the
    forest is fitted to and sees all of them, as a random key may well have no digit.
    """
    likely = docs.where(F.col("text").rlike(CANDIDATE))
    matches = F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), 1)
    split = likely.select(
        _key().alias("key"), "doc_id", "path", matches.alias("found"), F.split("text", CANDIDATE, -1).alias("pieces")
    ).where(F.size("found") > 0)
    # Places: the lengths of all pieces and candidates before.
    starts = F.aggregate(
        F.sequence(F.lit(0), F.size("found") - 1),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda s, i: let(
            s["at"] + F.length(F.get("pieces", i)),
            lambda here: F.struct(
                (here + F.length(F.get("found", i))).alias("at"), F.concat(s["all"], F.array(here)).alias("all")
            ),
        ),
        lambda s: s["all"],
    )
    each = split.withColumn("starts", starts).select(
        "key", "doc_id", "path", "pieces", "starts", F.posexplode("found").alias("number", "match")
    )
    head = F.regexp_extract("match", f"^({_ASSIGNED})", 1)
    value = F.substring(F.col("match"), F.length("head") + 1, F.length("match"))
    return (
        each.withColumn("head", head)
        .withColumn("value", value)
        .where(F.lit(every) | (F.col("head") != "") | F.col("value").rlike("[0-9]"))
        .select(
            "key",
            "doc_id",
            "path",
            "number",
            (F.get("starts", F.col("number")) + F.length("head")).alias("start"),
            "value",
            "head",
            F.right(F.get("pieces", F.col("number")), F.lit(NEAR)).alias("left"),
            F.left(F.get("pieces", F.col("number") + 1), F.lit(NEAR)).alias("right"),
        )
    )


def corpus_words(docs: DataFrame) -> DataFrame:
    """Per lower-case word of letters in all texts: word and n. Counted on the map side before the shuffle."""
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    return docs.select(words.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def _transition_table(words: DataFrame) -> Column:
    """Log probability of each pair of letters a-z in the corpus as a literal map; 676 entries at most."""
    plain = words.where(F.col("word").rlike("^[a-z]{2,}$"))
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    pairs = plain.select("n", "word", at.alias("i")).select("n", F.expr("substring(word, i, 2)").alias("pair"))
    rows = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    shares = {}
    for a in _LETTERS:
        after = sum(rows.get(a + b, 0) for b in _LETTERS)
        shares |= {a + b: (rows.get(a + b, 0) + 0.5) / (after + 13.0) for b in _LETTERS}
    logs = F.transform(F.array(*map(F.lit, shares.values())), lambda share: F.log(share))
    values = words.sparkSession.range(1).select(logs.alias("logs")).first()["logs"]
    # Two expressions in the plans that carry the map, not two for each entry.
    return F.from_json(F.lit(json.dumps(dict(zip(shares, values, strict=True)))), "map<string,double>")


def _shares(value: Column) -> dict[str, Column]:
    size = F.greatest(F.lit(1), F.length(value)).cast("double")
    kinds = F.translate(value, _LETTERS, "a" * 26)
    kinds = F.translate(F.translate(kinds, _LETTERS.upper(), "A" * 26), "0123456789", "9" * 10)
    runs = F.regexp_extract_all(kinds, F.lit("(a+|A+|9+|[^aA9]+)"), 1)
    return {
        "length": size,
        "digits": F.length(F.regexp_replace(value, "[^0-9]", "")) / size,
        "uppers": F.length(F.regexp_replace(value, "[^A-Z]", "")) / size,
        "lowers": F.length(F.regexp_replace(value, "[^a-z]", "")) / size,
        "marks": F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")) / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "switches": F.size(runs) / size,
        "longest_run": F.array_max(F.transform(runs, F.length)) / size,
    }


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``. ``words`` is :func:`corpus_words` of the corpus.

    The longest runs of letters of all candidates meet the dictionary in one equi-join of distinct runs.
    """
    log_share = _transition_table(words)
    runs = F.regexp_extract_all(F.lower("value"), F.lit(r"(\p{L}{3,})"), 1)
    rows = found.withColumn("runs", runs)
    wanted = rows.select(F.explode("runs").alias("word")).distinct()
    known = wanted.join(words.where(F.col("n") >= LEAST_COUNT), "word")
    hits = rows.select("key", "number", F.explode("runs").alias("word")).join(known, "word")
    covered = hits.groupBy("key", "number").agg(
        F.sum(F.length("word")).alias("known_letters"), F.max(F.length("word")).alias("longest_known")
    )
    size = F.greatest(F.lit(1), F.length("value")).cast("double")
    lower = F.lower("value")
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(lower) - 1)), lambda i: F.substring(lower, i, F.lit(2))
    )
    logs = F.filter(F.transform(pairs, lambda p: F.try_element_at(F.col("log_share"), p)), lambda x: x.isNotNull())
    usual = F.when(
        F.size(logs) > 0, F.aggregate(logs, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.lit(1), F.size(logs))
    ).otherwise(F.lit(-4.0))
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    around = F.concat(F.col("left"), F.lit(" "), F.col("right"))
    number = {
        **_shares(F.col("value")),
        "transitions": usual,
        "coverage": F.coalesce("known_letters", F.lit(0)) / size,
        "longest_word": F.coalesce("longest_known", F.lit(0)),
        "named": F.col("head") != "",
        "quoted": F.col("head").rlike("[\"']$"),
        "path_depth": F.length(F.regexp_replace(path, "[^/.]", "")),
        "path_example": path.rlike(_FOR_SHOW),
        "value_example": F.col("value").rlike(_EXAMPLE),
        "near_example": F.col("left").rlike(rf"{_FOR_SHOW}\W{{1,4}}(?:\w{{1,12}}\W{{1,4}})?$"),
        "near_name": F.col("left").rlike(rf"(?i)(?:{_NAMES})\W{{0,4}}$"),
        "near_digest": F.col("left").rlike(rf"{_DIGEST_NAMES}\W{{0,4}}$") | F.col("value").rlike(rf"{_DIGEST_NAMES}[=_/+-]"),
        "near_digits": F.length(F.regexp_replace(around, "[^0-9]", "")) / F.lit(2.0 * NEAR),
    }
    rows = rows.join(covered, ["key", "number"], "left").withColumn("log_share", log_share)
    return rows.select(*found.columns, *[number[name].cast("double").alias(name) for name in FEATURES])


def labelled_findings(docs: DataFrame, documents: int = LABEL_DOCUMENTS) -> DataFrame:
    """Labelled findings made from a bounded sample of documents: text, path and label.

    Neighbourhoods are the documents' own words. Keys in the usual shapes are secrets wherever they stand; words and
    numbers of the same documents in the same places are none: passwords that are words, joined words, dates, counters,
    placeholders. Both kinds come with and without digits. Digests (hexadecimal, base 64) are told by what is around
    them: after a name of a secret they are secrets wherever the document lies; after 'commit', 'sha256' and the like,
    after a word such as 'example', or alone in a document below an example or test path they are none; elsewhere they
    are secrets. Each document has every shape in ``PLACES_EACH`` of the places. Values are drawn from digests of the
    documents, so that every run makes the same rows.
    """
    # The documents with the smallest hashes; only hashes meet in one task, texts stay where they are.
    drawn = docs.where("text is not null").select("path", "text", F.xxhash64("text", "doc_id").alias("draw"))
    last = drawn.select("draw").orderBy("draw").limit(documents).agg(F.max("draw")).first()[0]
    sample = drawn.where(F.col("draw") <= F.lit(last).cast("long"))
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    base = sample.select("path", F.md5("text").alias("seed"), F.slice(words, 1, 60).alias("w")).where(F.size("w") >= 12)
    draw = F.sha2("seed", 256)
    strong = F.translate(F.base64(F.unhex(draw)), "+/=", "xYz")
    # Letters alone: each digit becomes another letter.
    letters = F.translate(strong, "0123456789", "qWzKxJvHgB")

    def word(i: int) -> Column:
        return F.get("w", F.lit(i))

    # Names with the mark that closes their value; names without an assignment; names of digests; words for show.
    named = [("password=", ""), ('token = "', '"'), ("secret: ", ""), ("api_key='", "'")]
    loose = [("token (", ")"), ('password "', '"'), ("api_key -> ", ""), ("secret ", "")]
    digests = [("commit ", ""), ("sha256: ", ""), ('etag: "', '"'), ("md5=", ""), ("checksum ", ""), ("commit/", "")]
    shown = [("for example ", ""), ("sample: ", ""), ("test key ", ""), ("example (", ")")]
    folders = ["examples", "test", "tests/data", "fixtures", "demo"]
    # Places: what stands around the value, whether the path is one of examples, and what a digest is there.
    places = [
        ([("", "")], False, 1),
        (named, False, 1),
        (loose, False, 1),
        (digests, False, 0),
        (shown, False, 0),
        ([("", "")], True, 0),
        (named, True, 1),
        (loose, True, 1),
        (digests, True, 0),
    ]
    values = {
        # Secrets: short hexadecimal, capital letters and digits, mixed. Digests have no label of their own.
        "hex18": (F.substring(draw, 1, 18), 1),
        "hex40": (F.substring(draw, 3, 40), None),
        "hex32": (F.md5(draw), None),
        "base64": (F.substring(strong, 1, 28), None),
        "hex64": (F.sha2(draw, 256), None),
        "capitals": (F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(strong, "[^A-Za-z0-9]", "Q")), 1, 16)), 1),
        "mixed": (F.concat(F.substring(strong, 5, 10), F.lit("_"), F.substring(strong, 20, 14)), 1),
        "letters": (F.substring(letters, 3, 24), 1),
        "capital_letters": (F.concat(F.lit("AKIA"), F.substring(F.upper(letters), 7, 16)), 1),
        "small_letters": (F.substring(F.lower(letters), 11, 20), 1),
        # None: words, joined words, words with numbers, dates and counters, placeholders.
        "word": (F.lower(word(3)), 0),
        "words": (F.concat_ws("_", F.lower(word(2)), F.lower(word(5)), F.lower(word(7)), F.lit("2")), 0),
        "joined": (F.concat(F.lower(word(2)), F.lower(word(3)), F.lower(word(4)), F.lower(word(6)), F.lit("10")), 0),
        "path": (F.concat_ws("/", F.lit(""), F.lower(word(1)), F.lower(word(4)), F.lower(word(6)), F.lit("v1")), 0),
        "date": (F.concat(F.lit("2024-0"), F.pmod(F.hash("seed"), F.lit(9)) + 1, F.lit("-1"), F.lit("4_12-00-00")), 0),
        "number": (F.lpad(F.pmod(F.xxhash64("seed"), F.lit(10**15)).cast("string"), 16, "4"), 0),
        "placeholder": (F.concat(F.lit("your_"), F.lower(word(3)), F.lit("_here_1")), 0),
        "crosses": (F.lit("xxxxxxxxxxxxxxxx1234"), 0),
        "long_word": (F.lower(F.concat(word(8), word(1), word(9), word(10))), 0),
        "capital_words": (F.upper(F.concat(word(3), word(6), word(8), word(2))), 0),
        "camel": (F.concat(F.lower(word(1)), *[F.initcap(word(i)) for i in (5, 9, 11)]), 0),
        "hyphens": (F.concat_ws("-", F.lower(word(9)), F.lower(word(4)), F.lower(word(11)), F.lower(word(2))), 0),
        "folders": (F.concat_ws("/", F.lit(""), F.lower(word(8)), F.lower(word(10)), F.lower(word(2)), F.lower(word(7))), 0),
        "rule": (F.repeat(F.element_at(F.array(*map(F.lit, "-=_")), F.pmod(F.hash("seed"), F.lit(3)) + 1), 32), 0),
    }
    shapes = [
        F.struct(F.lit(i).alias("shape"), value.alias("value"), F.lit(label).cast("double").alias("own"))
        for i, (value, label) in enumerate(values.values())
    ]
    pairs = [
        F.struct(
            F.lit(i).alias("place"),
            F.array(*[F.struct(F.lit(a).alias("lead"), F.lit(b).alias("tail")) for a, b in around]).alias("around"),
            F.lit(show).alias("show"),
            F.lit(float(digest)).alias("digest"),
        )
        for i, (around, show, digest) in enumerate(places)
    ]
    rows = base.select("path", "seed", "w", F.explode(F.array(*shapes)).alias("s")).select(
        "path", "seed", "w", "s", F.explode(F.array(*pairs)).alias("p")
    )
    # Places and the words in them are dealt over documents and shapes.
    turn = F.pmod(F.hash("seed") + F.col("s.shape"), F.lit(len(places)))
    rows = rows.where(F.pmod(F.col("p.place") + turn, F.lit(len(places))) < PLACES_EACH)
    choice = F.pmod(F.xxhash64("seed", "s.shape", "p.place"), F.lit(60)).cast("int")
    here = F.get("p.around", F.pmod(choice, F.size("p.around")))
    folder = F.get(F.array(*map(F.lit, folders)), F.pmod(choice, F.lit(len(folders))))
    text = F.concat(
        F.concat_ws(" ", F.slice("w", 8, 8)), F.lit(" "), here["lead"], F.col("s.value"), here["tail"], F.lit(" "),
        F.concat_ws(" ", F.slice("w", 20, 8)),
    )
    path = F.when(F.col("p.show"), F.concat_ws("/", "path", folder, F.lit("notes"))).otherwise(F.col("path"))
    rows = rows.select(path.alias("path"), text.alias("text"), F.coalesce("s.own", "p.digest").alias("label"))
    return rows.where("text is not null")


def fit(labelled: DataFrame, words: DataFrame) -> PipelineModel | None:
    """A forest over labelled findings (text, path, label); None where one of the two labels is missing."""
    rows = labelled.withColumn("doc_id", F.monotonically_increasing_id())
    found = candidates(rows, every=True)
    labels = rows.select(_key().alias("key"), "label").groupBy("key").agg(F.max("label").alias("label"))
    table = materialize(featured(found, words).join(labels, "key").select("label", *FEATURES), "labelled")
    if table.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="probability"
    )
    return PipelineModel([assembler, forest.fit(assembler.transform(table))])


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per candidate of ``docs`` (doc_id, text, path): doc_id, key, number, start, length, value, score and is_secret.

    ``labelled`` are findings as :func:`labelled_findings` makes them, which is the default. Where nothing can be learnt
    from them, all candidates count as secrets. Null and empty texts have no candidates; a null path is an empty one.
    Repeated rows have the same candidates, each listed once; documents with the same id and other texts are told apart
    by ``key``. Other columns are ignored; no rows give no rows.
    """
    docs = docs.select("doc_id", "text", "path")
    words = materialize(corpus_words(docs), "corpus-words")
    labelled = materialize(labelled_findings(docs) if labelled is None else labelled, "findings")
    model = fit(labelled, words)
    found = materialize(candidates(docs, every=True).dropDuplicates(["key", "number"]), "candidates")
    rows = featured(found, words)
    if model is None:
        scored = rows.withColumn("score", F.lit(1.0))
    else:
        scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(
        "doc_id",
        "key",
        "number",
        "start",
        F.length("value").cast("long").alias("length"),
        "value",
        F.round("score", 6).alias("score"),
        (F.col("score") >= threshold).alias("is_secret"),
    )


def redact(docs: DataFrame, path: str = "source", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret found in ``text`` replaced by a mask, all other columns and rows as they are.

    Only texts with secrets are joined and rebuilt; the names they are assigned to stay.
    """
    whole = docs.select(F.struct("*").alias("doc"), "doc_id", "text", F.col(path).cast("string").alias("path"))
    secrets = scan(whole).where("is_secret").groupBy("key").agg(F.collect_set("number").alias("numbers"))
    secrets = materialize(secrets, "secrets")
    likely = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    rest = whole.where(~likely).select("doc.*")
    joined = whole.where(likely).withColumn("key", _key()).join(secrets, "key", "left")
    found = F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), 1)
    pieces = F.split("text", CANDIDATE, -1)

    def put(match: Column, i: Column) -> Column:
        masked = F.concat(F.regexp_extract(match, f"^({_ASSIGNED})", 1), F.lit(mask))
        return F.when(F.array_contains("numbers", i), masked).otherwise(match)

    rebuilt = let(
        F.struct(F.transform(found, put).alias("found"), pieces.alias("pieces")),
        lambda x: F.array_join(
            F.transform(
                x["pieces"], lambda piece, i: F.concat(piece, F.coalesce(F.get(x["found"], i), F.lit("")))
            ),
            "",
        ),
    )
    text = F.when(F.col("numbers").isNull(), F.col("text")).otherwise(rebuilt)
    return rest.union(joined.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*"))
