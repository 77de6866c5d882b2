"""Secret scans with a random forest that removes false positives [native]."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm._shared import durable

# Words that stand beside credentials, and words that stand beside harmless strings of the same look.
KEY_WORDS = "password passwd pwd secret token api_key apikey access_key auth bearer credential private_key client_secret".split()
HARMLESS_WORDS = "commit sha sha1 sha256 md5 checksum digest hash revision uuid guid etag integrity build version page order phone card isbn".split()
#: Words that people write but generators of credentials don't.
DICTIONARY = """the and for with this that from have not are was but all can your you our one out use get set new old key
user name test example sample demo dummy fake mock placeholder change changeme your_token insert here value string
password secret token admin root guest default local host server client data file path home index page config build
release version update install download image style script module package class function method object return
service system process thread session cookie account email message event error warning debug info null none true false
letter number order color width height left right center middle top bottom first last next previous""".split()
#: Candidates: runs of the characters that credentials are made of, with a digit, what is assigned to a name that ends in a
#: key word, what begins as known credentials do, and passwords in addresses.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+"
PREFIXED = (
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{12,}+|(?:gh[os]_|ghp_|github_pat_|sk_live_|rk_live_|xox[abp]-|AIza|glpat-|npm_)[A-Za-z0-9_-]{10,}+"
    r"|SG\.[A-Za-z0-9_-]{3,}+\.[A-Za-z0-9_-]{3,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{3,}+\.[A-Za-z0-9_-]*+)"
)
ADDRESS = r"://[^\s/:@\"']*+:[^\s/@\"']{3,}+(?=@)"
ASSIGNED = r"(?i)(?:" + "|".join(KEY_WORDS) + r")[\"']?\s{0,3}[:=]\s{0,3}[\"']?[^\s\"']{6,}+"
CONTEXT = 48
#: No candidate has fewer characters.
SHORTEST = 6
FEATURES = "length digits uppers lowers marks changes repeats distinct covered key_near harmless_near assigned quoted hex_only digits_only test_path known_prefix".split()
TEST_PATH = r"(?i)(^|[/_.-])(test|tests|spec|example|examples|sample|samples|doc|docs|fixture|fixtures|mock)([/_.-]|$)"
KNOWN_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk_live_|rk_live_|xox[abp]-|AIza|glpat-|npm_|SG\.)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(sizes: Column, block: int = 256) -> Column:
    """For each element of an array of ints the sum of those before it; blocks keep the copying linear."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int"))
    begun = lambda x, first: F.aggregate(x, F.array(first), lambda s, n: F.concat(s, F.array((F.element_at(s, -1) + n).cast("int"))))
    totals = F.transform(blocks, lambda b: F.aggregate(F.slice(sizes, b * block + 1, F.lit(block)), F.lit(0), lambda t, n: (t + n).cast("int")))
    inside = lambda starts: F.flatten(F.transform(blocks, lambda b: F.slice(begun(F.slice(sizes, b * block + 1, F.lit(block)), F.get(starts, b)), 1, F.size(F.slice(sizes, b * block + 1, F.lit(block))))))
    return _let(begun(totals, F.lit(0).cast("int")), inside)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """All candidates with their neighbourhood: (id, path, nth, start, value, before, after, text_hash).

    Whole texts are searched.  Documents that no pattern matches are left out before anything is cut, and each
    document's candidates are counted from 0 in ``nth``; ``start`` is the character at which the value begins.  Work is
    in proportion to the text and its candidates, and no text is copied for a candidate: neighbours are put together
    from the ends of the pieces into which the candidates cut the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    pattern = f"(?:{ASSIGNED})|(?:{PREFIXED})|(?:{ADDRESS})|(?:{RUN})"
    rows = docs.select(F.col(id_col).alias("_id"), (F.col(path_col) if path_col else F.lit(None)).cast("string").alias("_path"), F.xxhash64(text_col).alias("_hash"), text.alias("_text"))
    rows = rows.where(F.col("_text").rlike(pattern))
    near = -(-CONTEXT // SHORTEST)  # so many candidates reach over the context, whatever lies between them

    def each(x: Column) -> Column:
        # Piece i is what lies before candidate i, with that candidate; the last piece is what lies behind all.
        piece = lambda i: F.concat(F.get(x["gaps"], i), F.coalesce(F.get(x["all"], i), F.lit("")))
        of_pieces = F.sequence(F.lit(0), F.size(x["all"]))
        ends = F.struct(
            F.transform(of_pieces, lambda i: F.substring(piece(i), -CONTEXT, CONTEXT)).alias("tails"), F.transform(of_pieces, lambda i: F.substring(piece(i), 1, CONTEXT)).alias("heads"),
            _sums_before(F.transform(of_pieces, lambda i: F.char_length(piece(i)))).alias("starts"), x["gaps"].alias("gaps"), x["all"].alias("all"),
        )
        return _let(ends, candidates)

    def candidates(x: Column) -> Column:
        def one(found: Column, i: Column) -> Column:
            low = F.greatest(i - near, F.lit(0))
            before = F.concat(F.array_join(F.slice(x["tails"], low + 1, i - low), ""), F.substring(F.get(x["gaps"], i), -CONTEXT, CONTEXT))
            after = F.array_join(F.slice(x["heads"], i + 2, F.lit(near)), "")
            at = F.get(x["starts"], i) + F.char_length(F.get(x["gaps"], i))
            return F.struct(found.alias("all"), at.cast("int").alias("at"), F.substring(before, -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, CONTEXT).alias("after"))

        return F.transform(x["all"], one)

    cut = F.struct(F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)).alias("all"), F.split("_text", pattern, -1).alias("gaps"))
    found = rows.select("_id", "_path", "_hash", F.posexplode(_let(cut, each)).alias("nth", "_c")).select("_id", "_path", "_hash", "nth", "_c.*")
    # What a match says before the value, the value, and what closes the sentence behind it.
    lead = F.regexp_extract("all", r"(?i)^(?:(?:" + "|".join(KEY_WORDS) + r")[\"']?\s{0,3}[:=]\s{0,3}[\"']?|://[^:]*+:)", 0)
    found = found.withColumn("_lead", lead).withColumn("_rest", F.expr("substring(all, char_length(_lead) + 1)"))
    found = found.withColumn("value", F.regexp_replace("_rest", r"[,;.)\]}>]+$", ""))
    return found.select(
        F.col("_id").alias(id_col), F.col("_path").alias("path"), "nth", (F.col("at") + F.char_length("_lead")).alias("start"), "value",
        F.substring(F.concat("before", "_lead"), -CONTEXT, CONTEXT).alias("before"),
        F.substring(F.concat(F.expr("substring(_rest, char_length(value) + 1)"), "after"), 1, CONTEXT).alias("after"), F.col("_hash").alias("text_hash"),
    )


def _any_word(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike(r"(?<![a-z0-9])(" + "|".join(words) + r")(?![a-z0-9])").cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """Add the columns ``FEATURES``: length, character make-up and transitions, dictionary coverage, path, neighbours."""
    v = F.col("value")
    n = F.greatest(F.char_length(v), F.lit(1)).cast("double")
    share = lambda kept: F.char_length(F.regexp_replace(v, kept, "")) / n
    # Each character becomes its class; collapsing runs of a class counts the transitions between classes.
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9]", "-"), "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    runs = reduce(lambda c, x: F.regexp_replace(c, f"{x}+", x), ["-", "9", "A", "a"], classes)
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    covered = 1 - F.char_length(F.regexp_replace(F.lower(v), words, "")) / n
    return found.withColumns(
        {
            "length": n,
            "digits": share("[^0-9]"),
            "uppers": share("[^A-Z]"),
            "lowers": share("[^a-z]"),
            "marks": share("[A-Za-z0-9]"),
            "changes": (F.char_length(runs) - 1) / n,
            "repeats": F.char_length(F.regexp_replace(v, r"(.)\1{2,}", "")) / n,
            "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
            "covered": covered,
            "key_near": _any_word(F.substring(F.col("before"), -24, 24), KEY_WORDS),
            "harmless_near": _any_word(F.substring(F.col("before"), -24, 24), HARMLESS_WORDS),
            "assigned": F.col("before").rlike(r"[:=]\s{0,3}[\"']?$").cast("double"),
            "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
            "hex_only": v.rlike("^[0-9a-fA-F]+$").cast("double"),
            "digits_only": v.rlike("^[0-9]+$").cast("double"),
            "test_path": F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False)).cast("double"),
            "known_prefix": v.rlike(KNOWN_PREFIX).cast("double"),
        }
    )


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Findings with verdicts, written by rule from hashes: (path, value, before, after, label).

    Half are credentials of the common forms in contexts in which they leak; half are what scanners mistake for them:
    placeholders, checksums, revisions, identifiers, numbers, paths and encoded prose.  Deterministic.
    """
    i = F.col("id")
    pick = lambda seed, options: F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(len(options))) + 1).cast("int"))
    hexes = F.sha2(F.concat(i.cast("string"), F.lit("hex")), 256)
    more = F.sha2(F.concat(i.cast("string"), F.lit("more")), 256)
    base = F.regexp_replace(F.base64(F.unhex(F.concat(hexes, more))), "[=]", "")
    code = F.translate(F.upper(hexes), "01", "XZ")
    ends = F.pmod(F.xxhash64(i, F.lit("n")), F.lit(24)).cast("int")
    number = F.pmod(F.xxhash64(i, F.lit("num")), F.lit(10**16)).cast("string")
    pair = lambda sep: F.concat_ws(sep, pick("w1", DICTIONARY), pick("w2", DICTIONARY), pick("w3", DICTIONARY))
    uuid = F.concat_ws("-", *[F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    key = pick("key", KEY_WORDS)
    sep = pick("sep", [" = \"", "=\"", ": \"", "=", ": ", " = '"])
    said = F.concat(pick("lead", ["", "export ", "the new ", "my ", "const ", "  "]), key, sep)
    noted = F.concat(pick("lead", ["", "see ", "at ", "the ", "in "]), pick("harm", HARMLESS_WORDS), pick("sep2", [" ", ": ", "=", "/", " = \""]))
    prose = pick("prose", ["to have been there on ", "and then the next one is ", "la de les ", "und der ", "", "as of "])
    close = F.when(sep.contains('"'), '"').when(sep.contains("'"), "'").otherwise(pick("close", [" ", "\n", "", ","]))
    # (weight, label, value, before)
    kinds = [
        (3, 1, F.substring(hexes, 1, 40), said), (2, 1, F.expr("substring(sha2(concat(string(id), 'hex'), 256), 1, 16 + pmod(xxhash64(id, 'n'), 24))"), said),
        (2, 1, F.concat(F.lit("AKIA"), F.substring(code, 1, 16)), prose), (1, 1, F.concat(F.lit("AKIA"), F.substring(code, 1, 16)), said),
        (1, 1, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(base, "[+/]", "x"), 1, 36)), prose), (2, 1, F.substring(base, 1, 40), said),
        (1, 1, F.concat(F.substring(base, 2, 9), F.lit("!"), F.substring(hexes, 1, 3)), said), (1, 1, F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(base, "[+/]", "y"), 5, 24)), prose),
        (3, 0, F.substring(hexes, 1, 40), noted), (1, 0, hexes, noted), (1, 0, uuid, prose), (1, 0, uuid, noted), (2, 0, pair("_"), said), (2, 0, F.concat(pair("-"), F.lit("-"), ends.cast("string")), said),
        (1, 0, F.repeat(pick("x", ["x", "*", "0", "a"]), 20), said), (3, 0, number, prose), (1, 0, number, noted), (1, 0, F.concat(pair("/"), F.lit("/page2024/"), ends.cast("string")), prose),
        (1, 0, F.concat(F.initcap(pick("w1", DICTIONARY)), F.initcap(pick("w2", DICTIONARY)), F.initcap(pick("w3", DICTIONARY)), ends.cast("string")), prose),
        (1, 0, F.concat(F.lit("your_"), pick("w1", DICTIONARY), F.lit("_here")), said), (1, 0, F.substring(hexes, 1, 32), prose),
    ]
    total = sum(k[0] for k in kinds)
    at, kind, below = F.pmod(F.xxhash64(i, F.lit("kind")), F.lit(total)), None, 0
    for weight, label, value, before in kinds:
        below += weight
        made = F.struct(F.lit(label).alias("label"), value.alias("value"), before.alias("before"))
        kind = F.when(at < below, made) if kind is None else kind.when(at < below, made)
    test = F.pmod(F.xxhash64(i, F.lit("test")), F.lit(10)) < F.when(F.col("_k.label") == 0, 3).otherwise(1)
    path = F.when(test, pick("tp", ["tests/unit/a.py", "docs/readme.md", "example/app.js"])).otherwise(pick("p", ["src/app.py", "deploy/main.tf", "config/.env", None]))
    return spark.range(rows).withColumn("_k", kind).select("_k.label", "_k.value", "_k.before", close.alias("after"), path.alias("path"))


def train_forest(labelled: DataFrame, trees: int = 24, depth: int = 8, sample: int = 20_000) -> PipelineModel:
    """A random forest over ``FEATURES`` from at most ``sample`` labelled findings (value, before, after, path, label)."""
    rows = with_features(labelled.where(F.col("label").isNotNull() & F.col("value").isNotNull()).limit(sample))
    rows = rows.select(*FEATURES, F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.8)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def forest_score(model: PipelineModel) -> Column:
    """The forest as one column expression: the mean over trees of the share of credentials in the leaf reached.

    The trees are one constant (their number and depth are bounded); a fold walks each from its root.  Scoring is
    plain column work, and what it needs is part of the plan.
    """
    trees, deepest = [], 0
    for tree in model.stages[-1].trees:
        nodes: list[dict] = []

        def add(node, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append({})
            if node.subtreeDepth() == 0:
                counts = list(node.impurityStats().stats())
                nodes[at] = {"f": -1, "t": 0.0, "l": at, "r": at, "v": counts[1] / sum(counts)}
            else:
                split = node.split()
                nodes[at] = {"f": split.featureIndex(), "t": split.threshold(), "v": 0.0, "l": add(node.leftChild()), "r": add(node.rightChild())}
            return at

        root = tree._call_java("rootNode")
        deepest = max(deepest, root.subtreeDepth())
        add(root)
        trees.append(nodes)
    forest = F.from_json(F.lit(json.dumps(trees)), "array<array<struct<f:int,t:double,l:int,r:int,v:double>>>")

    def walk(tree: Column, x: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            at = F.get(tree, node)
            return F.when(F.get(x, F.greatest(at["f"], F.lit(0))) <= at["t"], at["l"]).otherwise(at["r"])

        last = F.aggregate(F.sequence(F.lit(1), F.lit(max(deepest, 1))), F.lit(0), step)
        return F.get(tree, last)["v"]

    features = F.array(*[F.col(c) for c in FEATURES])
    return _let(features, lambda x: F.aggregate(forest, F.lit(0.0), lambda s, tree: s + walk(tree, x))) / len(trees)


def scan_secrets(
    docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None
) -> DataFrame:
    """All findings of all documents with the forest's verdict.

    Candidates come from patterns; a random forest trained on ``labelled`` findings (``labelled_findings`` by default)
    scores length, character make-up and transitions, dictionary coverage, path and neighbouring words.

    Returns one row for each candidate: id, nth, start, length, value, score, secret (score >= ``threshold``), text_hash.
    NULL and empty texts have no candidates; a NULL path is no test path; a NULL id stays NULL.  Texts of any length
    are searched whole, and so are values of any length.  Repeated rows and repeated
    values are findings each.  Empty tables give an empty table; other columns are ignored.
    """
    model = train_forest(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    # Candidates and features are written, few as they are: patterns, features and forest are then three short plans, each
    # of which compiles, and none is computed again for every step in a tree.
    found = durable(findings(docs, id_col, text_col, path_col), "secrets")
    scored = durable(with_features(found), "secrets").withColumn("_score", forest_score(model))
    return scored.select(
        id_col, "nth", "start", F.char_length("value").alias("length"), "value", F.col("_score").alias("score"), (F.col("_score") >= threshold).alias("secret"), "text_hash"
    )


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret value of ``found`` replaced by ``mark`` in its document, which id and text's hash name: a NULL id is an id."""
    values = found.where("secret").groupBy(F.col(id_col).alias("_s_id"), F.col("text_hash").alias("_s_hash")).agg(F.sort_array(F.collect_set("value"), asc=False).alias("_s_values"))
    joined = docs.join(values, docs[id_col].eqNullSafe(values["_s_id"]) & (F.xxhash64(docs[text_col]) == values["_s_hash"]), "left")
    clean = F.aggregate(F.coalesce("_s_values", F.array().cast("array<string>")), docs[text_col], lambda t, v: F.replace(t, v, F.lit(mark)))
    return joined.withColumn(text_col, clean).drop("_s_id", "_s_hash", "_s_values")
