"""Secrets in texts, with a random forest that removes false findings.

Everything is DataFrame and ML operations of Spark. Findings are taken inside words: runs
of twelve key characters with a digit, whatever is assigned to the name of a secret (six
characters, with or without digits, in the same word or the next), and passwords in the
user part of a link. Findings in formats that leave no doubt are the labels: keys of
providers, passwords of links and long assignments to a name of a secret on one side;
addresses, numbers, digests, paths and dictionary words on the other. The forest learns
from length, character transitions, coverage by words that are frequent in the corpus,
the path and the neighbouring words; the format rules themselves are not among its
features. It gives every finding a probability.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import columns_of, stage, whole

#: Labelled findings of the fitted sample on average, half of them of each label; trees, their depth and the least probability of a secret.
SAMPLE = 20_000
TREES = 40
DEPTH = 8
CERTAIN = 0.5
SEED = 17

# Names of secrets, of other long values, and words that show a made-up one.
SECRET_NAMES = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential"
OTHER_NAMES = "sha1|sha256|md5|digest|hash|checksum|commit|uuid|guid|isbn|etag|revision|version|order|invoice|build"
TEST_PATHS = "test|example|sample|fixture|mock|demo|doc"
CONFIG_FILES = "env|ya?ml|json|ini|cfg|conf|properties|toml|pem|key"
CODE_FILES = "py|js|ts|java|go|rb|c|cpp|rs|sh|sql"

#: Characters of an assigned value at least, and of a run that stands by itself.
SHORTEST = 6
RUN_LENGTH = 12
#: Findings in a word, in this order: the password of a link (1); a name (2) and its value (3); a run (4).
IN_WORD = (
    r"://[^\s:/@]*+:([^\s/@]{4,})@"
    r"|([A-Za-z][A-Za-z0-9_.-]*+)[\"']?(?:=|:(?!//))[\"'(]*((?![A-Za-z]*+://)[^\s\"'&,;(){}<>]{" + str(SHORTEST) + r",})"
    r"|([A-Za-z0-9_+/.~-]{" + str(RUN_LENGTH) + r",}={0,2})"
)
ASSIGNED = f"(?i)(?:{SECRET_NAMES})[\"']?[=:]"
#: A dictionary word has four letters or more and stands in at least this many documents, and in one of so many of them.
LEAST_DOCUMENTS = 3
ONE_OF = 5_000

FEATURES = (
    "length", "digits", "upper", "lower", "marks", "distinct", "to_digit", "to_letter", "to_upper", "pairs",
    "hexadecimal", "covered", "quoted", "named", "other_named", "left_secret", "left_other", "right_sentence",
    "test_path", "config_path", "code_path", "path_depth",
)


def dictionary(docs: DataFrame) -> DataFrame:
    """token: the lower-cased words of letters that are frequent in the texts, by the documents that hold them."""
    texts = columns_of(docs, "text")
    words = F.array_distinct(F.regexp_extract_all(F.lower(whole()), F.lit(r"(?<![\p{L}\p{N}_])\p{L}{4,40}(?![\p{L}\p{N}_])"), F.lit(0)))
    counted = texts.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held_by"))
    least = texts.agg(F.greatest(F.lit(LEAST_DOCUMENTS), F.count(F.lit(1)) / ONE_OF)).scalar()
    return counted.where(F.col("held_by") >= least).select("token")


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, path, word_no (from 0), run_no (in the word, from 0), word, value, name, left, right of each finding.

    `docs` has doc_id, text and source, which is the path. Words are cut at white space.
    value is what was found, without the name assigned to, quotes and closing punctuation.
    """
    def of(words: F.Column) -> F.Column:
        def word(i: F.Column) -> F.Column:
            return F.get(words, i)

        def assigned(i: F.Column) -> F.Column:
            before = F.coalesce(word(i - 1), F.lit(""))
            ended = before.endswith("=") | before.endswith(":")
            return ended & F.concat(F.coalesce(word(i - 2), F.lit("")), before).rlike(ASSIGNED + "$")

        def wanted(i: F.Column) -> F.Column:
            run = word(i).rlike(f"[A-Za-z0-9_+/.~=-]{{{RUN_LENGTH}}}") & word(i).rlike("[0-9]")
            inside = word(i).rlike("[=:]") & (word(i).rlike(ASSIGNED) | word(i).rlike("://[^/@]*:[^/@]*@"))
            return (F.length(word(i)) >= SHORTEST) & (run | inside | assigned(i))

        def around(i: F.Column) -> F.Column:
            before = [word(i - k) for k in (3, 2, 1)]
            return F.struct(
                i.alias("word_no"),
                word(i).alias("word"),
                F.lower(F.concat_ws(" ", *before)).alias("left"),
                F.coalesce(word(i + 1), F.lit("")).alias("right"),
                assigned(i).alias("assigned"),
            )

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), wanted), around)

    # The words are bound as the one element of an array, else they would be split anew for every one of them.
    rows = columns_of(docs, "doc_id", "text", "source").select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("path"),
        F.explode(F.get(F.transform(F.array(F.split(whole(), r"\s+")), of), F.lit(0))).alias("f"),
    ).select("doc_id", "path", "f.*")
    groups = [F.regexp_extract_all("word", F.lit(IN_WORD), F.lit(k)) for k in (1, 2, 3, 4)]
    bare = F.regexp_replace("word", r"^[\"'(\[{<]+|[\"')\]}>,;.]+$", "")
    named = F.regexp_extract("left", r"([a-z][a-z0-9_.-]*)[\"']?\s*[=:]$", 1)
    inside = F.transform(
        F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("link", "name", "value", "run"))]),
        lambda g: F.struct(
            F.when(g["link"] != "", "password").otherwise(F.lower(g["name"])).alias("name"),
            F.regexp_replace(F.concat(g["link"], g["value"], g["run"]), r"[^A-Za-z0-9_+/=!$%*#-]+$", "").alias("value"),
        ),
    )
    after = F.array(F.struct(named.alias("name"), bare.alias("value")))
    found = rows.select(
        "doc_id", "path", "word_no", "word", "left", "right",
        F.posexplode(F.when(F.col("assigned") & ~F.col("word").rlike("://[^/@]*:[^/@]*@"), after).otherwise(inside)).alias("run_no", "f"),
    ).select("doc_id", "path", "word_no", "run_no", "word", "f.value", "f.name", "left", "right")
    secret = F.col("name").rlike(f"(?:{SECRET_NAMES})$") & (F.length("value") >= SHORTEST - 2)
    return found.where(secret | ((F.length("value") >= RUN_LENGTH) & F.col("value").rlike("[0-9]")))


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds covered, the share of a value's characters in dictionary words, cut at other characters and at case changes."""
    numbered = stage(found.withColumn("_finding", F.monotonically_increasing_id()), "secret_numbered")
    cut = F.split(F.lower(F.regexp_replace("value", r"(?<=\p{Ll})(?=\p{Lu})", " ")), r"[^\p{L}]+")
    tokens = numbered.select("_finding", F.explode(F.filter(cut, lambda t: F.length(t) >= 4)).alias("token"))
    sums = tokens.join(stage(words, "secret_dictionary"), "token").groupBy("_finding").agg(F.sum(F.length("token")).alias("letters"))
    share = F.coalesce(F.col("letters"), F.lit(0)) / F.greatest(F.length("value"), F.lit(1))
    return numbered.join(sums, "_finding", "left").withColumn("covered", share.cast("double")).drop("_finding", "letters")


def described(found: DataFrame) -> DataFrame:
    """Adds the rest of FEATURES, all numbers, to findings with covered."""
    value, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")

    def share(pattern: str) -> F.Column:
        return F.regexp_count(value, F.lit(pattern)) / n

    def flag(column: F.Column) -> F.Column:
        return column.cast("double")

    left = F.col("left")
    return found.select(
        "*",
        n.alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("upper"),
        share("[a-z]").alias("lower"),
        share("[^A-Za-z0-9]").alias("marks"),
        (F.size(F.array_distinct(F.split(value, ""))) / n).alias("distinct"),
        share("[A-Za-z](?=[0-9])").alias("to_digit"),
        share("[0-9](?=[A-Za-z])").alias("to_letter"),
        share("[a-z](?=[A-Z])").alias("to_upper"),
        share("(?i)[bcdfghjklmnpqrstvwxz](?=[aeiouy])").alias("pairs"),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hexadecimal"),
        flag(F.col("word").rlike("^.?[\"']|[=:][\"']")).alias("quoted"),
        flag(F.col("name").rlike(f"(?:{SECRET_NAMES})$")).alias("named"),
        flag(F.col("name").rlike(f"(?:{OTHER_NAMES})$")).alias("other_named"),
        flag(left.rlike(f"(?:{SECRET_NAMES})[\"']?\\s*[=:]?$")).alias("left_secret"),
        flag(left.rlike(f"\\b(?:{OTHER_NAMES})[\"']?\\s*[=:]?$")).alias("left_other"),
        flag(F.col("right").rlike("^[a-z]+[,.]?$")).alias("right_sentence"),
        flag(F.lower("path").rlike(TEST_PATHS)).alias("test_path"),
        flag(F.lower("path").rlike(f"(?:^|[./])(?:{CONFIG_FILES})$")).alias("config_path"),
        flag(F.lower("path").rlike(f"[.](?:{CODE_FILES})$")).alias("code_path"),
        F.regexp_count("path", F.lit("[/\\\\]")).cast("double").alias("path_depth"),
    )


def rule_label(found: DataFrame) -> DataFrame:
    """Adds rule, the format that settles a finding, and label, 1.0 or 0.0; both null where none does."""
    value, word = F.col("value"), F.regexp_replace("word", r"^[\"'(<]+|[\"')>,;.!?]+$", "")
    named = F.col("name").rlike(f"(?:{SECRET_NAMES})$")
    made_up = F.lower(value).rlike("example|changeme|placeholder|your|[$][{(]|^[x*.]+$")
    rule = (
        F.when(value.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "provider key")
        .when(value.rlike("^(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9._-]+)$"), "provider key")
        .when(word.rlike("://[^/@]*:[^/@]*@") & named & ~made_up & (F.col("covered") < 1), "link password")
        .when(named & (F.col("covered") == 1), "named word")
        .when(named & value.rlike("^[A-Za-z0-9_+/=-]{12,}$") & ~made_up, "assignment")
        .when(word.rlike("^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+$"), "address")
        .when(~named & word.rlike("^[a-z]+://"), "link")
        .when(~named & word.rlike("^[0-9 ()+.,:/-]+$"), "number")
        .when(~named & value.rlike("^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"), "uuid")
        .when(F.col("name").rlike(f"(?:{OTHER_NAMES})$") | F.col("left").rlike(f"\\b(?:{OTHER_NAMES})[\"']?\\s*[=:]$"), "digest")
        .when(~named & value.rlike("^[A-Za-z]+[0-9]{0,2}$") & ~value.rlike("^[A-Z0-9]+$"), "word")
    )
    label = F.when(rule.isin("provider key", "link password", "assignment"), 1.0).when(rule.isNotNull(), 0.0)
    return found.withColumn("rule", rule).withColumn("label", label)


#: Characters that stand in for hexadecimal digits in rewritten secrets.
OTHER_CHARACTERS = "Kq7Zr-2LxW9mT4b!"


def rewritten(labelled: DataFrame) -> DataFrame:
    """The labelled findings, and of each assigned secret a short form, half of them in other characters.

    Formats settle long values only, often all of one alphabet. Without short forms the
    forest would take length and alphabet for what makes a secret.
    """
    draw = F.xxhash64("doc_id", "word_no", "run_no", "value")
    short = F.substring("value", F.lit(1), (F.pmod(draw, F.lit(6)) + SHORTEST).cast("int"))
    other = F.translate(short, "0123456789abcdef", OTHER_CHARACTERS)
    forms = labelled.where(F.col("rule").isin("assignment", "link password")).drop(*[f for f in FEATURES if f != "covered"])
    forms = described(forms.withColumn("value", F.when(F.pmod(draw, F.lit(4)) < 2, other).otherwise(short)))
    return labelled.unionByName(forms)


def _totals(labelled: DataFrame) -> dict[float, int]:
    """Rows of each label, by the label."""
    rows = labelled.where("label IS NOT NULL").groupBy(F.col("label").cast("double").alias("label")).count().orderBy("label")
    return {r["label"]: r["count"] for r in rows.collect()}


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row for each finding: doc_id, word_no, run_no, value, rule, probability, is_secret.

    `docs` has doc_id, text and source. `labelled` has the columns of `described` and
    label, 0.0 or 1.0; without it the findings a rule settles are the labels. About
    SAMPLE / 2 of each label, drawn by a hash, are then fitted with their `rewritten`
    forms, all of a label that has fewer, and both labels weigh the same before the forms are added, however rare one is. If only one label occurs,
    it is the probability of every finding; without any it is 0.5. A provider key has the
    probability 1 whatever the forest says. A finding is a secret at CERTAIN or more. Null, empty and
    findingless texts give no row; repeated rows give theirs again; a null source is an empty path; other columns are ignored.
    """
    found = stage(rule_label(described(covered(findings(docs), dictionary(docs)))), "secret_findings")
    names = list(FEATURES)
    weight = F.lit(1.0)
    if labelled is None:
        labelled = found.where("label IS NOT NULL")
        share, totals = F.lit(0), _totals(labelled)
        for label, total in totals.items():
            share = F.when(F.col("label") == label, int(min(1.0, SAMPLE / 2 / total) * (1 << 30))).otherwise(share)
            weight = F.when(F.col("label") == label, 1 / min(1.0, 2 * total / SAMPLE)).otherwise(weight)
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", "word_no", "run_no", "value"), F.lit(1 << 30)) < share)
        labelled = rewritten(labelled)
        kinds = list(totals)
    else:
        kinds = list(_totals(labelled))
    labelled = stage(labelled.select(*names, F.col("label").cast("double"), weight.alias("weight")), "secret_labels")
    if len(kinds) < 2:
        scored = found.withColumn("probability", F.lit(kinds[0] if kinds else 0.5))
    else:
        vectors = VectorAssembler(inputCols=names, outputCol="vector", handleInvalid="keep")
        forest = RandomForestClassifier(
            featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2
        ).fit(vectors.transform(labelled.where("label IS NOT NULL")))
        chances = forest.transform(vectors.transform(found))
        scored = chances.withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    sure = F.coalesce(F.col("rule") == "provider key", F.lit(False))
    scored = scored.withColumn("probability", F.when(sure, 1.0).otherwise(F.col("probability")))
    return scored.select(
        "doc_id", "word_no", "run_no", "value", "rule", "probability", (F.col("probability") >= CERTAIN).alias("is_secret")
    )
