"""Secret scans: candidate strings by pattern and by context, false positives removed by a random forest.

Candidates, features and scores are DataFrame expressions and MLlib stages; no Python runs on the rows. A candidate is
judged by its length, its character classes and their transitions, the share of it that dictionary words cover, the
path it stands on, and the words beside it. The dictionary is what the corpus itself uses often.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.rows import inlined
from linescope.functions.text import bind
from linescope.session import materialise

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: A candidate: so many characters of keys, digests and encodings, with a digit or inner capitals.
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
MIXED = "[0-9]|[a-z][A-Z]"
#: Candidates by context, of any length and characters: what a credential's name is assigned (quoted, with spaces, or up
#: to white space), the password of a URL, a block of a private key.
_NAME = (
    "(?i:token|secret|passw|passphrase|passcode|pass(?![A-Za-z])|pwd|api[_.-]?key|bearer|credential|private[_.-]?key|access[_.-]?key|auth(?!or|en))"
    "[A-Za-z0-9_.-]*[\"'`]?[ \\t]*(?:=>|[:=]{1,3})[ \\t]*"
)
_USER = "[A-Za-z][A-Za-z0-9+.-]*://[^\\s/:@]*:"
_KEY_BLOCK = "-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----"
HEAD = f"^(?:{_NAME}[\"'`]?|{_USER})"
CONTEXT = (
    f"{_KEY_BLOCK}[\\s\\S]*?(?:-----END [A-Z0-9 ]*-----|\\z)"
    f"|{_NAME}(?:\"[^\\n]+?(?<!\\\\)\"|'[^\\n]+?(?<!\\\\)'|`[^\\n]+?`|\\S*[^\\s,;\"'`])"
    f"|{_USER}[^\\s/]+(?=@)"
)
#: Ends of a prefix, and starts of a value, that tell a secret as an assigned name does.
IN_URL = "://[^\\s/:@]*:$"
#: Names that credentials are assigned to.
NAMES = "(?i)(?:token|secret|passw|passwd|pwd|api.?key|apikey|auth|bearer|credential|private|access.?key)"
ASSIGNED = "[=:]"
#: Character classes whose shares and transitions are features.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "mark": "[+/_=-]"}
#: Rows of a dictionary word, at least, and its letters.
DICTIONARY_ROWS = 20
DICTIONARY_WORD = "[a-z]{3,}"
NEIGHBOUR_BUCKETS = 32
PATH_BUCKETS = 16
#: Bound of the labelled sample: findings with the smallest hashes.
LABELLED = 20_000
TREES = 40
DEPTH = 6
SEED = 7


#: Numbers that are summed at once, so that a sum of all before a place does not start at the first one.
BLOCK = 256


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _sums_before(numbers: Column) -> Column:
    """The sum of all numbers before each place, by blocks."""

    def placed(numbers: Column, starts: Column) -> Column:
        def one(_: Column, k: Column) -> Column:
            block = F.floor(k / BLOCK).cast("int")
            return F.get(starts, block) + _sum(F.slice(numbers, block * BLOCK + 1, k - block * BLOCK))

        return F.transform(numbers, one)

    def started(numbers: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(numbers) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: _sum(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))))
        starts = bind(lambda x: F.transform(x, lambda _, b: _sum(F.slice(x, F.lit(1), b))), sums)
        return bind(placed, numbers, starts)

    return bind(started, numbers)


def _first_from(rows: Column, field: str, least: Column) -> Column:
    """Place, from 0, of the first row whose ascending field is at least so much; the row count if none is."""

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        below = F.get(rows, middle)[field] < least
        return F.struct(
            F.when((s["low"] < s["high"]) & below, middle + 1).otherwise(s["low"]).alias("low"),
            F.when((s["low"] < s["high"]) & ~below, middle).otherwise(s["high"]).alias("high"),
        )

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(rows) + 1.0)).cast("int"))
    return F.aggregate(halvings, F.struct(F.lit(0).alias("low"), F.size(rows).alias("high")), step, lambda s: s["low"])


def candidates(docs: DataFrame, key: str, text: str, path: str | None) -> DataFrame:
    """(key, path, place, part, value, prefix, before, name, after): every candidate; ``place`` is the number, from 0, of
    the word it starts in, ``part`` its number in the word, or below 0 for a candidate that only its context shows.

    A candidate by pattern that is part of one by context, with the name or user before it, is left to it. Both kinds are
    in the order of the text, so each looks the other up by its word; the time grows with the candidates, not their pairs,
    but for those inside one word.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def breaks(x: Column) -> Column:
        return F.regexp_count(x, F.lit(WORD_BREAK))

    def by_context(words: Column, body: Column) -> Column:
        """Structs as of the pattern beside ``last``, the word that the value ends in, and ``whole``, the match."""

        def counted(parts: Column, matches: Column) -> Column:
            # White space never lies across the ends of a match, so its runs count the words before it.
            runs = F.transform(matches, lambda m, k: breaks(F.get(parts, k)) + breaks(m))
            return bind(listed, parts, matches, _sums_before(runs))

        def listed(parts: Column, matches: Column, sums: Column) -> Column:
            lead = F.when(body.rlike(f"^{WORD_BREAK}"), 1).otherwise(0)

            def one(m: Column, k: Column) -> Column:
                def made(head: Column) -> Column:
                    quote = F.regexp_extract(head, "[\"'`]$", 0)
                    rest = F.substr(m, F.length(head) + 1)
                    value = F.when((quote != "") & F.endswith(rest, quote), F.substr(rest, F.lit(1), F.length(rest) - 1)).otherwise(rest)
                    return bind(placed, F.get(sums, k) + breaks(F.get(parts, k)) + breaks(head) - lead, value, head)

                def placed(place: Column, value: Column, head: Column) -> Column:
                    def near(i: Column) -> Column:
                        return F.when(i >= 0, F.get(words, F.greatest(i, F.lit(0))))

                    last = place + breaks(value)
                    return F.struct(
                        place.alias("place"),
                        (-1 - k).alias("part"),
                        value.alias("value"),
                        F.regexp_extract(head, "[^\\x20\\x09-\\x0D]*$", 0).alias("prefix"),
                        near(place - 1).alias("before"),
                        near(place - 2).alias("name"),
                        near(last + 1).alias("after"),
                        last.alias("last"),
                        m.alias("whole"),
                    )

                return bind(made, F.regexp_extract(m, HEAD, 0))

            return F.filter(F.transform(matches, one), lambda c: c["value"] != "")

        return bind(counted, F.split(body, CONTEXT, -1), F.regexp_extract_all(body, F.lit(f"({CONTEXT})"), F.lit(1)))

    def joined(pattern: Column, context: Column) -> Column:
        def between(rows: Column, low: Column, high: Column) -> Column:
            return bind(lambda a, b: F.slice(rows, a + 1, F.greatest(b - a, F.lit(0))), low, high)

        def inner(p: Column) -> Column:
            near = between(context, _first_from(context, "last", p["place"]), _first_from(context, "place", p["place"] + 1))
            return F.exists(near, lambda c: (c["value"] != p["value"]) & F.contains(c["whole"], p["value"]))

        def known(c: Column) -> Column:
            near = between(pattern, _first_from(pattern, "place", c["place"]), _first_from(pattern, "place", c["place"] + 1))
            return F.exists(near, lambda p: p["value"] == c["value"])

        fields = ("place", "part", "value", "prefix", "before", "name", "after")
        more = F.transform(F.filter(context, lambda c: ~known(c)), lambda c: F.struct(*[c[x].alias(x) for x in fields]))
        return F.when(F.size(context) == 0, pattern).otherwise(F.concat(F.filter(pattern, lambda p: ~inner(p)), more))

    def every(words: Column, body: Column) -> Column:
        return bind(joined, marked(words), by_context(words, body))

    def marked(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            def near(d: int) -> Column:
                return F.when(i + d >= 0, F.get(words, F.greatest(i + d, F.lit(0))))

            values = F.regexp_extract_all(w, F.lit(f"({CANDIDATE})"), F.lit(1))
            return F.transform(
                F.filter(values, lambda v: v.rlike(MIXED)),
                lambda v, k: F.struct(
                    i.alias("place"),
                    k.alias("part"),
                    v.alias("value"),
                    F.split_part(w, v, F.lit(1)).alias("prefix"),
                    near(-1).alias("before"),
                    near(-2).alias("name"),
                    near(1).alias("after"),
                ),
            )

        return F.flatten(F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                                              lambda x: x["w"].rlike(CANDIDATE)), lambda x: one(x["w"], x["i"])))

    # Most texts hold no candidate: one pass of the patterns leaves them out.
    some = docs.where(whole.rlike(f"{CANDIDATE}|{CONTEXT}"))
    words = F.filter(F.split(whole, WORD_BREAK, -1), lambda w: w != "")
    place = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    return inlined(some, [F.col(key).alias("key"), place.alias("path")], bind(every, words, whole), "place")


def dictionary(docs: DataFrame, text: str, rows: int = DICTIONARY_ROWS) -> DataFrame:
    """(word): lower-cased words of letters that stand in at least so many rows' texts, repeats in a row once."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(f"({DICTIONARY_WORD})"), F.lit(1)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rows).select("word")


def told(value: Column) -> Column:
    """Whether the candidate is a URL's password or a block of a private key."""
    return F.col("prefix").rlike(IN_URL) | value.rlike(f"^{_KEY_BLOCK}")


def features(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with one ``x_`` column per feature."""
    value = F.col("value")
    size = F.length(value).cast("double")
    out = {"x_length": size}
    for name, chars in CLASSES.items():
        out[f"x_{name}"] = F.regexp_count(value, F.lit(chars)) / size
        for other, next_ in CLASSES.items():
            out[f"x_{name}_{other}"] = F.regexp_count(value, F.lit(f"{chars}(?={next_})")) / size
    out["x_distinct"] = F.size(F.array_distinct(F.split(value, ""))) / size
    near = F.concat_ws(" ", "name", "before", "prefix")
    out["x_named"] = (near.rlike(NAMES) | (F.col("part") < 0)).cast("double")
    out["x_assigned"] = F.concat_ws(" ", "before", "prefix").rlike(ASSIGNED).cast("double")
    out["x_quoted"] = F.col("prefix").rlike("[\"'`]$").cast("double")
    for name in ("name", "after"):
        word = F.lower(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), "[^A-Za-z]", ""))
        out[f"x_{name}_word"] = F.pmod(F.xxhash64(word), F.lit(NEIGHBOUR_BUCKETS)).cast("double")
    out["x_path"] = F.pmod(F.xxhash64("path"), F.lit(PATH_BUCKETS)).cast("double")
    out["x_path_depth"] = F.regexp_count("path", F.lit("/")).cast("double")
    runs = F.regexp_extract_all(F.lower("value"), F.lit(f"({DICTIONARY_WORD})"), F.lit(1))
    # Letters of the value that dictionary words cover; equal values are looked up once.
    distinct = found.select("value").distinct()
    covered = (
        distinct.select("value", F.explode(runs).alias("word"))
        .join(known, "word", "left_semi")
        .groupBy("value")
        .agg(F.sum(F.length("word")).alias("letters"))
    )
    wide = found.join(covered, "value", "left").withColumns(out)
    return wide.withColumn("x_dictionary", F.coalesce(F.col("letters"), F.lit(0)) / F.length("value")).drop("letters")


def weak_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label`` by form and context: 1 for digests and keys that a credential's name is assigned, for
    passwords in URLs and key blocks, 0 for plain numbers and words, null where neither is sure."""
    value = F.col("value")
    named = F.concat_ws(" ", "name", "before", "prefix").rlike(f"{NAMES}[A-Za-z_]*[^A-Za-z]*{ASSIGNED}") | (F.col("part") < 0)
    dense = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    plain = value.rlike("^[0-9]+$") | ~value.rlike("[0-9]")
    return found.withColumn("label", F.when((named & dense) | told(value), 1.0).when(plain & ~named, 0.0))


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = "source",
    labelled: DataFrame | None = None,
    sample: int = LABELLED,
    least: float = 0.5,
) -> DataFrame:
    """(key, place, part, digest, length, probability, secret): one row per candidate, never the value itself.

    ``labelled`` holds findings as :func:`features` makes them, with a ``label`` of 1 or 0; without it the candidates of
    :func:`weak_labels` teach, at most ``sample`` of them. With labels of one class only, that class is the probability;
    without labels it is 0.5. ``digest`` is the value's SHA-256. Null, empty and blank texts have no candidates; null
    keys and paths are kept. Repeated rows give repeated findings. An empty table gives no rows. Other columns are
    ignored, whatever their names; texts are searched whole.
    """
    found = materialise(candidates(docs, key, text, path), "candidates")
    known = materialise(dictionary(docs, text), "dictionary")
    made = materialise(features(found, known), "features")
    taught = labelled if labelled is not None else weak_labels(made)
    order = F.xxhash64("value", "before", "after", "name", "place")
    rows = materialise(taught.where(F.col("label").isNotNull()).orderBy(order).limit(sample), "labelled")
    names = sorted(c for c in made.columns if c.startswith("x_"))
    classes = [r[0] for r in rows.select("label").distinct().collect()]  # 0 and 1 at most
    if len(classes) == 2:
        assembler = VectorAssembler(inputCols=names, outputCol="features")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, featureSubsetStrategy="sqrt")
        model = forest.fit(assembler.transform(rows).select("features", "label"))
        scored = model.transform(assembler.transform(made)).withColumn("p", vector_to_array("probability")[1])
    else:
        scored = made.withColumn("p", F.lit(float(classes[0]) if classes else 0.5))
    return scored.select(
        F.col("key").alias(key),
        F.col("place").cast("bigint").alias("place"),
        F.col("part").cast("bigint").alias("part"),
        F.sha2("value", 256).alias("digest"),
        F.length("value").cast("bigint").alias("length"),
        F.col("p").alias("probability"),
        (F.col("p") >= least).alias("secret"),
    )
