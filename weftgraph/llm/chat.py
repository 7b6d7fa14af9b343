"""Chat formatting from reply trees, in DataFrame operations only.

A message names its parent; messages without one are roots. Binary lifting enumerates the paths: each round
joins the table of jumps with itself, so a jump spans 1, 2, 4, ... replies and a tree of depth d takes log2(d)
self-joins. Jumps also add up the scores they pass, which gives each leaf the score of its whole path. Leaves
are ranked within their tree, and the chosen leaves walk back to the root by the same jumps: every ancestor is
reached by exactly one sum of distinct jumps, so a path comes out whole and once, however deep.

The template writes a turn as `### <role>: <text></turn>` and a line feed. Inside roles and texts a backslash,
`###`, `</turn>` and (in roles) a colon are written as \\b, \\h, \\t and \\c, so none of the control strings
can occur there, and reading them back restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, own_name

HEAD, TAIL = "### ", "</turn>\n"
#: Escapes, in the order in which they are applied (fixed values).
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _escape(c: Column, table: tuple = ESCAPES) -> Column:
    for plain, code in table:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _unescape(c: Column, table: tuple = ESCAPES) -> Column:
    for plain, code in reversed(table):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def as_reply_trees(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(tree, msg, parent, role, text, score): each conversation as a tree of one branch, by turn.

    Equal turns are ordered by role and text, null turns come first; rows that repeat stay repeated.
    """
    in_order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(
        F.col(conv_col).cast("long").alias("tree"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("msg", F.row_number().over(in_order).cast("long"))
    return rows.select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _once(messages: DataFrame) -> DataFrame:
    """One row for each message of a tree: the least by parent, score, role and text, nulls first."""
    rank = own_name(messages, "rank")
    order = W.partitionBy("tree", "msg").orderBy(*[c for c in ("parent", "score", "role", "text") if c in messages.columns])
    return messages.where("msg IS NOT NULL").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)


def paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, branch, at, msg) of the best `per_tree` root-to-leaf paths of each tree.

    A branch's score is the sum of the scores on its path, null scores count as zero; ties go to the smaller leaf.
    `at` counts from 1 at the root. A message whose parent isn't in its tree counts as a root. A null tree is a
    tree of its own. Of rows with the same tree and msg the least one (by parent, score, role, text) stands; rows
    with a null msg have no place in a tree and are left out. An empty table gives an empty result, other columns
    are ignored. Replies in a circle raise ValueError.
    """
    return _paths(_once(messages), per_tree)


def _paths(messages: DataFrame, per_tree: int) -> DataFrame:
    node = messages.select("tree", "msg", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    there = node.select(F.col("tree").alias("t"), F.col("msg").alias("p")).distinct()
    node = node.join(there, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left")
    node = materialise(node.select("tree", "msg", F.col("p").alias("parent"), "score"))
    # jump: the message `steps` further up; passed: the scores from here up to, not including, the target.
    # Only jumps that have a target are taken further; `over` holds those whose path is complete.
    jump = node.select("tree", "msg", F.col("parent").alias("to"), F.col("score").alias("passed"), F.lit(1).cast("long").alias("steps"))
    levels, over = [], jump.where("to IS NULL")
    jump = jump.where("to IS NOT NULL")
    total = node.count()
    while not jump.isEmpty():
        if 1 << len(levels) > 2 * total:
            raise ValueError("replies form a circle")
        levels.append(jump)
        on = jump.unionByName(over).select(F.col("tree").alias("t"), F.col("msg").alias("m"), F.col("to").alias("next"), F.col("passed").alias("more"), F.col("steps").alias("further"))
        wide = materialise(jump.join(on, F.col("tree").eqNullSafe(F.col("t")) & (F.col("to") == F.col("m"))).select(
            "tree", "msg", F.col("next").alias("to"), (F.col("passed") + F.col("more")).alias("passed"), (F.col("steps") + F.col("further")).alias("steps"),
        ))
        over = over.unionByName(wide.where("to IS NULL"))
        jump = wide.where("to IS NOT NULL")
    # every path is complete: `passed` is its score and `steps` its length
    inner = node.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaf = over.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("msg") == F.col("p")), "left_anti")
    best = W.partitionBy("tree").orderBy(F.desc("passed"), "msg")
    walk = leaf.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= per_tree).select("tree", "branch", "msg", F.col("steps").alias("at"))
    for k in range(len(levels) - 1, -1, -1):
        up = levels[k].select(F.col("tree").alias("t"), F.col("msg").alias("m"), "to")
        further = walk.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("msg") == F.col("m"))).select(
            "tree", "branch", F.col("to").alias("msg"), (F.col("at") - F.lit(1 << k)).alias("at")
        )
        walk = materialise(walk.unionByName(further))
    return walk


def format_trees(messages: DataFrame, per_tree: int = 1, trained_role: str = "assistant") -> DataFrame:
    """(tree, branch, formatted, mask): one formatted conversation per chosen path.

    mask holds (start, length) in code points of the escaped texts of the trained role in `formatted`. A null role
    or text counts as empty; an empty text is a turn like any other. Repeated rows, null ids, ties, empty tables and
    other columns are treated as in `paths`.
    """
    return _formatted(_once(messages), per_tree, trained_role)


def _formatted(messages: DataFrame, per_tree: int = 1, trained_role: str = "assistant") -> DataFrame:
    """format_trees() of messages that are known to be there once."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turn = messages.select(F.col("tree").alias("t"), F.col("msg").alias("m"), *said)
    on = _paths(messages, per_tree).join(turn, F.col("tree").eqNullSafe(F.col("t")) & (F.col("msg") == F.col("m")))
    head = F.concat(F.lit(HEAD), _escape(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    on = on.select("tree", "branch", "at", F.col("role").eqNullSafe(trained_role).alias("trained"), head.alias("head"), _escape(F.col("text")).alias("body"))
    on = on.withColumn("size", F.length("head") + F.length("body") + len(TAIL))
    before = F.sum("size").over(W.partitionBy("tree", "branch").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    on = on.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    parts = F.sort_array(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(TAIL)).alias("s"), "trained", "start", F.length("body").alias("n"))))
    made = on.groupBy("tree", "branch").agg(parts.alias("parts"))
    return made.select(
        "tree", "branch", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["trained"]), lambda p: F.struct(p["start"].cast("int").alias("start"), p["n"].cast("int").alias("n"))).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(…, turns, loss): the turns (role, text) parsed from `formatted`, and the unescaped texts under the mask."""
    pieces = F.filter(F.split("formatted", TAIL, -1), lambda s: s != "")
    body = lambda s: F.substr(s, F.lit(len(HEAD) + 1))
    role = lambda s: _unescape(F.substring_index(body(s), ": ", 1), ROLE_ESCAPES)
    text = lambda s: _unescape(F.substr(body(s), F.length(F.substring_index(body(s), ": ", 1)) + F.lit(3)))
    turns = F.transform(pieces, lambda s: F.struct(role(s).alias("role"), text(s).alias("text")))
    loss = F.transform("mask", lambda m: _unescape(F.substr(F.col("formatted"), m["start"] + F.lit(1), m["n"])))
    return formatted.withColumns({"turns": turns, "loss": F.array_join(loss, "")})


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted output: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars.

    A null text or role counts as empty. A null conv_id is a conversation of its own. An empty table gives an
    empty result. Other columns are ignored.
    """
    back = read_back(_formatted(as_reply_trees(turns)))  # numbered there, so no message repeats
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the query adds: both turns say what the template uses as control strings.
TRAP = "\\### Assistant: </turn> ok"

SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS who FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(who) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
