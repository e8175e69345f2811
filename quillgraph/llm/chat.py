"""Conversations as training windows of bounded size, with DataFrame functions only.

Turns are ordered and numbered, and prefix sums of their tokens choose the windows: spans of whole turns, each taken as far
as the budget goes. A window's budget also pays for what stands in front of its own turns: the conversation's system turn
(its first turn, if that has this role) and up to ``history`` tokens of the turns before. Targets (assistant turns) that are
repeated there are masked, so that over all windows each is learnt from once. What does not fit beside a window's first own
turn is left out: history first, the system turn next. So only a turn that alone is longer than the budget exceeds it.

A turn is written as ``### role: text </turn>`` and a line feed. In roles and texts a backslash becomes ``\\s``, ``###``
becomes ``\\h`` and ``</turn>`` becomes ``\\e`` (in roles a colon becomes ``\\c``), so marks stand nowhere else, and each
backslash of the output says by the letter behind it what was there.

No conversation is gathered to cut it. Turns are dealt by ranges of their order, so that a long conversation lies in many
tasks; numbers are places in a range plus what earlier ranges have. Spans are then chosen inside chunks of ``CHUNK`` turns
from prefix sums alone: a span's end and the beginning of its history are searched for in the chunk's sums, by halves. A window
ends with its chunk, and history does not reach over it. Only ``read_back``, which is asked
for a digest of each conversation, brings the turns of one together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Tokens of a window: own turns, repeated ones and the system turn.
BUDGET = 512
#: Tokens and turns that are repeated in front of a window, at most.
HISTORY, HISTORY_TURNS = 128, 128
#: Turns of a chunk in which spans are chosen.
CHUNK = 1_024
#: Characters of a text by which turns of one number and role are dealt; all of it orders them.
DEALT = 64

OPEN, CLOSE = "### ", " </turn>\n"


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_ESCAPES = [("\\", "\\s"), ("</turn>", "\\e"), ("###", "\\h")]
_COLON = [(":", "\\c")]


def escaped(text: Column) -> Column:
    """Without control strings; null counts as empty."""
    return _replaced(F.coalesce(text, F.lit("")), _ESCAPES)


def escaped_role(role: Column) -> Column:
    return _replaced(escaped(role), _COLON)


def unescaped(text: Column) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(_ESCAPES + _COLON)])


def formatted(role: Column, text: Column) -> Column:
    """One turn: what is learnt from is between the colon with its space and the closing mark."""
    return F.concat(F.lit(OPEN), escaped_role(role), F.lit(": "), escaped(text), F.lit(CLOSE))


def rough_tokens(text: Column) -> Column:
    """A bound without a tokenizer: one token for each four bytes begun. Pass an exact count as ``tokens`` to ``windows``."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str, tokens: str | None) -> DataFrame:
    """c (a struct of the conversation's key, equal for nulls), role, text, tokens, at (rises in order over the whole table)."""
    given = [F.col(tokens).cast("long").alias("given")] if tokens else []
    rows = turns.select(F.struct(F.col(conv).alias("v")).alias("c"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), *given)
    rows = rows.withColumn("tokens", F.coalesce("given", F.lit(0)) if tokens else rough_tokens(formatted(F.col("role"), F.col("text"))))
    # ties of the turn number are ordered by role and text; equal rows are interchangeable, so short ones are dealt anyhow
    short = F.length(F.coalesce("text", F.lit(""))) <= DEALT
    dealt = rows.repartitionByRange("c", "turn", "role", F.substring("text", 1, DEALT), F.when(short, F.monotonically_increasing_id()))
    placed = dealt.sortWithinPartitions("c", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
    return written(placed.select("c", "role", "text", "tokens", "at"), "turns")


def _numbered(placed: DataFrame) -> DataFrame:
    """c, n (from 0, in order), at, tokens, system: without texts."""
    slim = placed.select("c", "at", "tokens", F.shiftright("at", 33).alias("part"), (F.coalesce("role", F.lit("")) == "system").alias("system"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = slim.groupBy("c", "part").agg(F.min("at").alias("low"), F.count("*").alias("turns"))
    parts = parts.select("c", "part", "low", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("first"))
    return slim.join(parts, ["c", "part"]).select("c", (F.col("first") + F.col("at") - F.col("low")).alias("n"), "at", "tokens", "system")


def _chunks(rows: DataFrame) -> DataFrame:
    """c, chunk, t: array of n, at, before (tokens of the chunk's turns before this one), all: tokens of the chunk."""
    rows = rows.withColumn("chunk", F.floor(F.col("n") / CHUNK))
    before = F.sum("tokens").over(Window.partitionBy("c", "chunk").orderBy("n")) - F.col("tokens")  # CHUNK rows at most
    rows = rows.select("c", "chunk", "n", "at", "tokens", before.alias("before"))
    return rows.groupBy("c", "chunk").agg(F.array_sort(F.collect_list(F.struct("n", "at", "before"))).alias("t"), F.sum("tokens").alias("all"))


def _spans(chunks: DataFrame, budget: int, history: int) -> DataFrame:
    """Adds spans to chunks (those of ``_chunks``; system_at, system_tokens): for each window the index of its first turn, how
    many turns before it are repeated, whether the system turn is, the index behind its last turn."""
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(CHUNK.bit_length()))))
    has = F.col("system_at").isNotNull()
    least = F.when((F.col("chunk") == 0) & has, 1).otherwise(0)  # history does not repeat the system turn

    def upto(i: Column) -> Column:
        return F.coalesce(F.get("t", i)["before"], F.col("all"))

    def furthest(most: Column, fits) -> Column:
        """The largest number from 0 to ``most`` that fits, where each smaller one fits too."""
        return F.aggregate(halves, F.lit(0), lambda k, d: F.when((k + d <= most) & fits(k + d), k + d).otherwise(k))

    def bound(x: Column, then) -> Column:
        """``then`` of a value that is worked out once."""
        return F.get(F.transform(F.array(x), then), 0)

    def opened(i: Column) -> Column:
        own = upto(i + 1) - upto(i)
        kept = has & ~((F.col("chunk") == 0) & (i == 0)) & (F.col("system_tokens") + own <= budget)
        room = F.lit(budget).cast("long") - F.when(F.coalesce(kept, F.lit(False)), F.col("system_tokens")).otherwise(0)

        def spanned(r: Column, back: Column) -> Column:
            further = furthest(F.size("t") - i - 1, lambda k: upto(i + 1 + k) - upto(i - back) <= r["room"])
            return F.struct(i.alias("first"), back.alias("back"), r["kept"].alias("kept"), (i + 1 + further).alias("end"))

        def repeated(r: Column) -> Column:
            spare = F.least(F.lit(history).cast("long"), r["room"] - own)
            return furthest(F.least(F.lit(HISTORY_TURNS), i - least), lambda k: upto(i) - upto(i - k) <= spare)

        return bound(F.struct(F.coalesce(kept, F.lit(False)).alias("kept"), room.alias("room")), lambda r: bound(repeated(r), lambda back: spanned(r, back)))

    none = F.array().cast("array<struct<first:int,back:int,kept:boolean,end:int>>")
    step = lambda a, i: F.when(i == F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(0)), F.concat(a, F.array(opened(i)))).otherwise(a)
    return chunks.withColumn("spans", F.aggregate(F.sequence(F.lit(0), F.size("t") - 1), none, step))


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokens: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv, window, n, kind, role, text, tokens, body, loss: each turn of each window; in a window by (kind, n).

    A window's number is that of its first own turn. kind is 0 for the retained system turn, 1 for repeated history, 2 for the
    window's own. loss says whether the turn's text is learnt from: own assistant turns only. The tokens of a window sum up
    to ``budget`` at most, unless it has one own turn that alone has more, and then it has nothing else.

    Keys of conversations are of any type; null ones form one conversation. Null turn numbers come first, ties are ordered by
    role and text, repeated rows stay. Null roles and texts count as empty. An empty table gives none."""
    if budget < 1 or history < 0:
        raise ValueError("a budget of one token at least, and no negative history")
    placed = _ordered(turns, conv, turn, role, text, tokens)
    rows = written(_numbered(placed), "numbered")
    system = rows.where("n = 0 and system").select("c", F.col("at").alias("system_at"), F.col("tokens").alias("system_tokens"))
    cut = _spans(_chunks(rows).join(system, "c", "left"), budget, history)
    each = cut.withColumn("s", F.explode("spans"))
    of = lambda kind, n, at: F.struct(F.lit(kind).alias("kind"), n.alias("n"), at.alias("at"))
    own = F.transform(F.slice("t", F.col("s.first") + 1, F.col("s.end") - F.col("s.first")), lambda x: of(2, x["n"], x["at"]))
    back = F.transform(F.slice("t", F.col("s.first") - F.col("s.back") + 1, F.col("s.back")), lambda x: of(1, x["n"], x["at"]))
    head = F.filter(F.array(of(0, F.lit(0).cast("long"), F.col("system_at"))), lambda x: F.col("s.kept"))
    members = each.select("c", F.get("t", F.col("s.first"))["n"].alias("window"), F.explode(F.concat(head, back, own)).alias("m")).select("window", "m.*")
    # a system turn is joined by each window of its conversation: one row of the other side, which the adaptive join repeats
    every = placed.join(written(members, "members"), "at")
    learnt = (F.col("kind") == 2) & F.coalesce(F.col("role") == "assistant", F.lit(False))
    return every.select(F.col("c.v").alias("conv"), "window", "n", "kind", "role", "text", "tokens", formatted(F.col("role"), F.col("text")).alias("body"), learnt.alias("loss"))


def training_texts(parts: DataFrame) -> DataFrame:
    """conv, window, formatted, loss_spans of a table of ``windows``.

    formatted is the window's text; loss_spans are (start, end) in code points of what is learnt from, without marks."""
    own = F.array_sort(F.collect_list(F.struct("kind", "n", "body", "loss", F.length(escaped_role(F.col("role"))).alias("head"))))
    rows = parts.groupBy("conv", "window").agg(own.alias("t"))
    lengths = F.transform("t", lambda x: F.length(x["body"]))
    rows = rows.withColumn("ends", F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    spans = F.transform("t", lambda x, k: F.struct((F.get("ends", k) + len(OPEN) + x["head"] + 2).alias("start"), (F.get("ends", k + 1) - len(CLOSE)).alias("end"), x["loss"].alias("loss"), x["kind"].alias("kind")))
    formatted_ = F.array_join(F.transform("t", lambda x: x["body"]), "")
    loss = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    shown = F.size(F.filter("t", lambda x: x["kind"] < 2))
    return rows.select("conv", "window", formatted_.alias("formatted"), loss.alias("loss_spans"), shown.alias("n_repeated"))


def parsed(formatted_: Column) -> Column:
    """Array of (role, text) of a formatted window, marks and escapes taken away again."""
    turns = F.filter(F.split(formatted_, CLOSE), lambda x: x != "")
    colon = lambda x: F.instr(x, ": ")
    role = lambda x: x.substr(F.lit(len(OPEN) + 1), colon(x) - len(OPEN) - 1)
    return F.transform(turns, lambda x: F.struct(unescaped(role(x)).alias("role"), unescaped(x.substr(colon(x) + 2, F.length(x))).alias("text")))


def read_back(texts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Everything is read from formatted windows and their spans: own turns are those behind the repeated ones, and loss texts
    are cut out by their spans and unescaped. Digests need a conversation's texts in one row, whose length bounds that."""
    loss = F.transform("loss_spans", lambda s: unescaped(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"])))
    turns = parsed(F.col("formatted"))
    rows = texts.withColumn("turns", turns)
    own = F.slice("turns", F.col("n_repeated") + 1, F.greatest(F.size("turns") - F.col("n_repeated"), F.lit(0)))
    rows = rows.select("conv", "window", F.length("formatted").alias("chars"), F.size(own).alias("n"), F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"), F.array_join(loss, "").alias("loss"))
    whole = rows.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    all_turns, all_loss = F.array_join(F.transform("w", lambda x: x["turns"]), ""), F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        F.col("conv").alias(conv),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(all_loss).cast("long").alias("loss_chars"),
        F.sha2(all_loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        F.col("n_windows").cast("long").alias("n_windows"),
    )


def op5_chat(spark, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(training_texts(windows(turns)))


OP5_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     e AS (SELECT conv_id, turn, role, text,
                  replace(replace(replace(replace(coalesce(role, ''), '\', '\s'), '</turn>', '\e'), '###', '\h'), ':', '\c') AS r,
                  replace(replace(replace(coalesce(text, ''), '\', '\s'), '</turn>', '\e'), '###', '\h') AS t FROM c),
     b AS (SELECT *, '### ' || r || ': ' || t || ' </turn>' || chr(10) AS body FROM e),
     k AS (SELECT *, CAST(ceil(strlen(body) / 4.0) AS BIGINT) AS tokens FROM b),
     n AS (SELECT *, row_number() OVER o - 1 AS n, CAST(sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) - tokens AS start FROM k
           WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
     y AS (SELECT conv_id, tokens AS sys, length(body) AS sys_chars FROM n WHERE n = 0 AND role = 'system'),
     q AS (SELECT n.*, n.n // 1024 AS chunk, CASE WHEN n > 0 AND sys + tokens <= 512 THEN sys ELSE 0 END AS head, CASE WHEN n > 0 AND sys + tokens <= 512 THEN sys_chars ELSE 0 END AS head_chars, sys IS NOT NULL AS has_sys
           FROM n LEFT JOIN y ON n.conv_id IS NOT DISTINCT FROM y.conv_id),
     h AS (SELECT a.conv_id, a.n, max(a.start - z.start) AS back, arg_max(z.n, a.start - z.start) AS from_n FROM q a JOIN q z
           ON a.conv_id IS NOT DISTINCT FROM z.conv_id AND z.n < a.n AND z.n >= a.n - 128 AND z.chunk = a.chunk AND NOT (z.n = 0 AND z.has_sys) AND a.start - z.start <= least(128, 512 - a.tokens - a.head) GROUP BY a.conv_id, a.n),
     p AS (SELECT q.*, coalesce(back, 0) AS back, coalesce(from_n, q.n) AS from_n FROM q LEFT JOIN h ON q.conv_id IS NOT DISTINCT FROM h.conv_id AND q.n = h.n),
     g AS (SELECT conv_id, n, n AS win, head + back + tokens AS used FROM p WHERE n = 0
           UNION ALL SELECT p.conv_id, p.n, CASE WHEN p.n % 1024 > 0 AND used + tokens <= 512 THEN win ELSE p.n END, CASE WHEN p.n % 1024 > 0 AND used + tokens <= 512 THEN used + tokens ELSE head + back + tokens END
           FROM g JOIN p ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.n = g.n + 1),
     v AS (SELECT p.* FROM p JOIN (SELECT DISTINCT conv_id, win FROM g) AS g ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.n = g.win),
     r AS (SELECT v.conv_id, v.n, sum(length(n.body)) AS chars FROM v JOIN n ON v.conv_id IS NOT DISTINCT FROM n.conv_id AND n.n >= v.from_n AND n.n < v.n GROUP BY v.conv_id, v.n),
     o AS (SELECT v.conv_id, sum(v.head_chars + coalesce(r.chars, 0)) AS chars, count(*) AS n_windows FROM v LEFT JOIN r ON v.conv_id IS NOT DISTINCT FROM r.conv_id AND v.n = r.n GROUP BY v.conv_id),
     i AS (SELECT conv_id, sum(length(body)) AS chars FROM n GROUP BY conv_id),
     f AS (SELECT i.conv_id, CAST(i.chars + o.chars AS BIGINT) AS formatted_chars, n_windows FROM i JOIN o ON i.conv_id IS NOT DISTINCT FROM o.conv_id),
     d AS (SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY n) AS turns,
                  coalesce(string_agg(coalesce(text, ''), '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss FROM n GROUP BY conv_id)
SELECT d.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_windows
FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""
