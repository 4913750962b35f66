"""Chat formatting from reply trees.

Messages point at their parents.  Self-joins that double the jump length give
every message its distance and total score to the root in about log2(depth)
rounds; leaves are ranked by branch score; the chosen leaves are then expanded
to their whole paths by the same jumps, and each path becomes one formatted
conversation with a loss mask.  Built-in Spark expressions only.

Template: ``[INST] text [/INST]`` for a user turn, ``text`` closed by ``</s>``
for an assistant turn, ``<<SYS>> text <</SYS>>`` for a system turn, and
``[INST role] text [/INST]`` for any other role.  A control string inside a
text gets one backslash after its opening bracket, one more than it may
already have there, so the escape is reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import let, shared_table

CONTROL = r"(/?INST(?: [^\[\]<>]*)?\]|/?SYS>>|/?s>)"
_ESCAPE = r"(<<|<|\[)(\\*)" + CONTROL
_UNESCAPE = r"(<<|<|\[)\\(\\*)" + CONTROL
TURN = (r"(?s)\[INST\] (.*?) \[/INST\]\n|<s> (.*?) </s>\n|<<SYS>> (.*?) <</SYS>>\n"
        r"|\[INST ([^\[\]<>]*)\] (.*?) \[/INST\]\n")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _other_role(role: Column) -> Column:
    """A role name safe inside a marker: brackets, percent signs and line ends percent-coded."""
    for ch, code in (("%", "%25"), ("[", "%5B"), ("]", "%5D"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A")):
        role = F.replace(role, F.lit(ch), F.lit(code))
    return role


def _role_name(code: Column) -> Column:
    for ch, c in (("\n", "%0A"), (">", "%3E"), ("<", "%3C"), ("]", "%5D"), ("[", "%5B"), ("%", "%25")):
        code = F.replace(code, F.lit(c), F.lit(ch))
    return code


def _turn(role: Column, text: Column) -> Column:
    """``head, body, tail`` of one formatted turn; a NULL role is an empty name."""
    role, body = F.coalesce(role, F.lit("")), escape(F.coalesce(text, F.lit("")))
    head = (F.when(role == "user", "[INST] ").when(role == "assistant", "<s> ").when(role == "system", "<<SYS>> ")
            .otherwise(F.concat(F.lit("[INST "), _other_role(role), F.lit("] "))))
    tail = (F.when(role == "assistant", " </s>\n").when(role == "system", " <</SYS>>\n").otherwise(" [/INST]\n"))
    return F.struct(head.alias("head"), body.alias("body"), tail.alias("tail"), role.alias("role"))


def branch_leaves(messages: DataFrame, top: int | None = 1):
    """``(leaves, jumps)``: the ``top`` best-scored leaves per conversation
    (all when None; ties to the smaller id) and the jump tables.

    ``messages``: ``conv, id, parent, score`` with ``(conv, id)`` unique.  A
    parent that does not exist makes its child a root; messages on or below a
    parent cycle have no root and belong to no path."""
    ids = messages.select("conv", F.col("id").alias("parent"), F.lit(True).alias("real")) \
        .filter(F.col("parent").isNotNull())
    m = (messages.join(ids, ["conv", "parent"], "left")
         .select("conv", "id", F.when(F.col("real"), F.col("parent")).alias("up"),
                 F.coalesce("score", F.lit(0.0)).alias("score")))
    level = shared_table(m.select("conv", "id", "up", F.lit(1).cast("long").alias("depth"), "score"), "jump-0")
    longest = level.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps, reach = [level], 1
    while reach < longest and not jumps[-1].filter(F.col("up").isNotNull()).isEmpty():
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        step = a.join(b, (F.col("a.conv") == F.col("b.conv")) & (F.col("a.up") == F.col("b.id")), "left").select(
            "a.conv", "a.id", F.col("b.up").alias("up"),
            (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"),
            (F.col("a.score") + F.coalesce("b.score", F.lit(0.0))).alias("score"))
        jumps.append(shared_table(step, f"jump-{len(jumps)}"))
        reach *= 2
    rooted = jumps[-1].filter(F.col("up").isNull())
    parents = level.filter(F.col("up").isNotNull()).select("conv", F.col("up").alias("id")).distinct()
    leaves = rooted.join(parents, ["conv", "id"], "left_anti").select(
        "conv", F.col("id").alias("leaf"), "depth", F.col("score").alias("branch_score"))
    if top is not None:
        order = Window.partitionBy("conv").orderBy(F.col("branch_score").desc(), F.col("leaf"))
        leaves = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("rank")
    return leaves, jumps


def paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """``conv, leaf, branch_score, id, place``: each chosen path, root at place 1."""
    leaves, jumps = branch_leaves(messages, top)
    on = leaves.select("conv", "leaf", "branch_score", F.col("leaf").alias("id"), F.col("depth").alias("place"))
    for k in range(len(jumps) - 1, -1, -1):
        j = jumps[k].filter(F.col("up").isNotNull()).select(
            F.col("conv").alias("j_conv"), F.col("id").alias("j_id"), "up")
        far = on.join(j, (F.col("conv") == F.col("j_conv")) & (F.col("id") == F.col("j_id"))).select(
            "conv", "leaf", "branch_score", F.col("up").alias("id"), (F.col("place") - 2 ** k).alias("place"))
        on = shared_table(on.unionByName(far), f"paths-{k}")
    return on


def format_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """``conv, leaf, branch_score, formatted, loss`` per chosen path.

    ``messages``: ``conv, id, parent, score, role, text``.  ``loss`` lists the
    (start, length) spans of assistant texts in ``formatted``, in code points."""
    texts = messages.select(F.col("conv").alias("m_conv"), F.col("id").alias("m_id"), "role", "text")
    p = paths(messages.select("conv", "id", "parent", "score"), top)
    rows = p.join(texts, (F.col("conv") == F.col("m_conv")) & (F.col("id") == F.col("m_id")))
    turns = rows.groupBy("conv", "leaf", "branch_score").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", _turn(F.col("role"), F.col("text")).alias("t")))),
                    lambda x: x["t"]).alias("turns"))
    whole = lambda t: F.concat(t["head"], t["body"], t["tail"])
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(whole(t))).alias("at"),
            F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))))
            .otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return turns.select("conv", "leaf", "branch_score",
                        F.array_join(F.transform("turns", whole), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The ``(role, text)`` turns of a formatted conversation, unescaped."""
    pieces = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))

    def turn(p: Column) -> Column:
        named = F.regexp_extract(p, r"^\[INST ([^\[\]<>]*)\] ", 1)
        role = (F.when(p.startswith("[INST] "), "user").when(p.startswith("<s> "), "assistant")
                .when(p.startswith("<<SYS>> "), "system").otherwise(_role_name(named)))
        head = (F.when(role == "user", 7).when(role == "assistant", 4).when(role == "system", 8)
                .otherwise(F.length(named) + 8))
        is_other = p.startswith("[INST ") & ~p.startswith("[INST] ")
        head = F.when(is_other, F.length(named) + 8).otherwise(head)
        tail = (F.when(p.startswith("<s> "), 6).when(p.startswith("<<SYS>> "), 10).otherwise(9))
        body = F.substring(p, head + 1, F.length(p) - head - tail)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation, read back from it: ``n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``."""
    back = formatted.withColumn("turns", read_turns(F.col("formatted")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return back.withColumn("loss_text", loss).select(
        "conv", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "branch_score")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """A turn list as a reply tree: each row answers the row before it.

    Rows are ordered by turn (NULL first), then role and text, so rows that
    share a turn all stay; score is 0."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        F.col("conv_id").alias("conv"), F.row_number().over(order).alias("id"), "role", "text") \
        .select("conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"),
                F.lit(0.0).alias("score"), "role", "text")


#: DuckDB: the same digests straight from the rows.
ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       sum(length(t) + len(regexp_extract_all(t, '(<<|<|\[)(\\*)(/?INST(?: [^\[\]<>]*)?\]|/?SYS>>|/?s>)'))
           + CASE r WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 WHEN 'system' THEN 18
             ELSE 17 + length(r) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
