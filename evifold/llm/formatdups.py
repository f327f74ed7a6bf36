"""Records that are the same but for outward form: collapse them and count the copies.

A record is brought to a canonical text (characters, case, white space, punctuation, order of fields), the
text is hashed to 128 bits, and the groups are counted by hash, partly before the shuffle. A second,
independent 64-bit hash is aggregated beside it: two texts behind one 128-bit hash show as two values of
the second one, and the operator then groups by the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifold.functions.text import computed_once, fold_case, nfkc
from evifold.plans.checkpoints import cut_lineage

ACTION = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("requirement_ids", T.ArrayType(T.StringType())),
        T.StructField("query", T.StringType()),
        T.StructField("_broken", T.StringType()),
    ]
)
_STRICT = {
    "columnNameOfCorruptRecord": "_broken",
    "allowSingleQuotes": "false",
    "allowUnquotedFieldNames": "false",
    "allowNonNumericNumbers": "false",
}
FIELD, ITEM = "\x1e", "\x1f"
#: What parts words: all but letters with their marks, and digits. With signs kept, those of comparison and arithmetic
#: stay, and points and commas between digits.
BREAK = r"[^\p{L}\p{M}\p{N}]+"
BREAK_BUT_SIGNS = r"(?:(?!(?<=\p{N})[.,](?=\p{N})|[-\u2212](?=\p{N}))[^\p{L}\p{M}\p{N}<>=+±≤≥≠%])+"
#: Rows of a group that are joined by key; groups of more are hot. A hot group has at least so many rows, so that the
#: number of hot groups is at most the rows over it; it is counted before they are broadcast.
HOT_ROWS, MOST_HOT = 100_000, 200_000


def canonical_searches(df: DataFrame, id_col: str = "log_id", action_col: str = "executed_action", signs: bool = False) -> DataFrame:
    """(item_id, canon): canonical text of each logged search action; all other rows give none.

    Characters are brought to NFKC, so that composed and decomposed letters and full and half width are equal. Words are
    letters with their marks and digits, as TESTDATA.md has it; with ``signs`` the signs of comparison and arithmetic, a
    minus and a decimal point count too, so that "p < 0.05" and "p > 0.05" stay apart.

    NULL ids, NULL, cut-off or otherwise broken JSON, other actions and queries without a word give no row. A missing
    field counts as an empty one; the order of the fields never matters, the order of ``requirement_ids`` does.
    """
    breaks = BREAK_BUT_SIGNS if signs else BREAK
    spaced = lambda c: F.coalesce(F.trim(F.regexp_replace(c, breaks, " ")), F.lit(""))
    rows = df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(action_col).cast("string").alias("logged")).where("item_id is not null and logged is not null")
    parsed = computed_once(rows, "j", F.from_json("logged", ACTION, _STRICT)).where("j._broken is null").select("item_id", "j")
    ids = F.transform(F.coalesce(F.col("j.requirement_ids"), F.array()), spaced)
    text = F.concat(spaced(F.col("j.action")), F.lit(FIELD), spaced(F.col("j.channel")), F.lit(FIELD), F.concat_ws(ITEM, ids), F.lit(FIELD), F.col("query"))
    normal = parsed.select("item_id", "j", nfkc(F.col("j.query")).alias("asked"))
    worded = computed_once(normal, "query", spaced(F.col("asked"))).where(F.col("query").rlike(r"[\p{L}\p{N}]")).select("item_id", text.alias("text"))
    return computed_once(worded, "canon", fold_case(F.col("text"))).where(F.col("canon").startswith("search" + FIELD)).select("item_id", "canon")


def keyed(texts: DataFrame) -> DataFrame:
    """``item_id``, the 128-bit key ``h`` and the control value ``chk`` of each row with a canonical text and an id."""
    sound = texts.where(F.col("canon").isNotNull() & F.col("item_id").isNotNull())
    return sound.select("item_id", F.unhex(F.md5("canon")).alias("h"), F.xxhash64("canon").alias("chk"))


def copy_groups(keys: DataFrame) -> DataFrame:
    """One row per key: its smallest id, its number of rows, and the range of the control values."""
    return keys.groupBy("h").agg(
        F.min("item_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"),
        F.min("chk").alias("chk_lo"), F.max("chk").alias("chk_hi"),
    )


def _checked(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys and groups, written once; keyed by the texts themselves if one 128-bit hash stands for two texts."""
    keys = cut_lineage(keyed(texts))
    groups = cut_lineage(copy_groups(keys))
    if groups.where("chk_lo != chk_hi").limit(1).count():
        keys = cut_lineage(texts.where("canon is not null and item_id is not null").select("item_id", F.col("canon").cast("binary").alias("h"), F.lit(0).cast("bigint").alias("chk")))
        groups = cut_lineage(copy_groups(keys))
    return keys, groups


def distinct_records(texts: DataFrame) -> DataFrame:
    """(keep_id, n_copies): each distinct record once, with the number of its copies, itself included.

    ``texts`` has ``item_id`` and ``canon``. Rows where either is NULL are left out; an empty table gives no rows; rows
    that are equal in both count as copies.
    """
    return _checked(texts)[1].select("keep_id", "n_copies")


def duplicate_pairs(texts: DataFrame) -> DataFrame:
    """(keep_id, dup_id): one row for each record but the one with the smallest id of its group.

    Groups of more than HOT_ROWS rows, whose number is at most the rows over HOT_ROWS, go to the rows by broadcast as long as there
    are no more than MOST_HOT of them, so no task gathers a hot group; all others are joined by key. Beyond MOST_HOT the
    bound of a group that is joined by key doubles until they fit. Nulls and empty tables: as in :func:`distinct_records`.
    """
    keys, groups = _checked(texts)
    groups = groups.where("n_copies > 1").select("h", "keep_id", "n_copies")
    least = HOT_ROWS
    while groups.where(F.col("n_copies") > least).limit(MOST_HOT + 1).count() > MOST_HOT:
        least *= 2
    hot = F.broadcast(groups.where(F.col("n_copies") > least))
    rows = keys.select("h", "item_id")
    from_hot = rows.join(hot, "h")
    from_rest = rows.join(hot, "h", "left_anti").join(groups.where(F.col("n_copies") <= least), "h")
    pairs = from_hot.unionByName(from_rest)
    return pairs.where("item_id > keep_id").select("keep_id", F.col("item_id").alias("dup_id"))
