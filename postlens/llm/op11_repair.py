"""Conversation structure repair: the cheapest edits that give a well-formed
order of roles, by a dynamic program over grammar-compressed fault sequences.

Each row of a conversation becomes a symbol: the initial of its role and
whether its text is whole or truncated, or one symbol for rows that have to go.
Cutting the sequences into pieces of bounded length, Re-Pair replaces the most
frequent adjacent symbols of all distinct pieces by rules, round by round: the
pairs are counted by Spark, and what the driver gets is bounded by the square
of the number of symbols.  Every symbol has one min-plus transfer matrix over
the four states of ``(s?(ua)+)?``; the matrix of a rule is the product of the
matrices of its two symbols, evaluated bottom-up, once for all conversations.
An entry is a cost and an audit rope: the middle state through which the best
edits run, so that a rule's audit is two references into its parts and never a
copied text.  A conversation is read in the rules' symbols, its best path
expanded to the audit, and the edits applied to its rows as they stream by.

Why the matrices may be multiplied in any order: of two different edit strings
of equal cost for the same rows neither is a prefix of the other (the longer
one would hold more insertions and cost more), so comparing them is decided
within the strings and appending to both does not change it.

Faults, states and costs are those of the docstring of :func:`repair`.  Two
passes over the rows: the first shuffles keys, roles and digests only, the
second the texts, sorted by conversation and read as a stream: a conversation's
symbols and audit are held in memory, its texts are hashed as they come.

Defined results: a null role or text is one space (so a blank row); rows of one
turn come in the order of role and of the text's SHA-256; repeated rows are
duplicates; a null key is a conversation of its own; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, shared_table

#: Costs of the edits (fixed values of the contract).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Symbols: X must go; else the role's initial (o: any other), upper case where the text is truncated.
BASE = "XsuaoSUAO"
#: States of the automaton: nothing yet, after s, after u, after a.
STATES, START = 4, 0
ACCEPT = (0, 3)
KEEP_TO = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # the turn that a rerole or an insertion adds: user, but assistant after user

#: Rows of a piece; rules of the grammar, rules made in one round, and rounds.
PIECE, MAX_RULES, RULES_A_ROUND, ROUNDS = 4096, 512, 64, 12

BLANKS = " \t\n\x0b\x0c\r"


# -- damage --------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) damaged by crc32(``conv_id:turn``) % 20:
    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it,
    4 sets its role to user.  Nulls in the key, role and text are one space."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    key = F.concat(filled("conv_id"), F.lit(":"), filled("turn"))
    hit = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"),
                      (F.crc32(key) % 20).alias("hit")).filter("hit != 0")
    hurt = hit.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return hurt.drop("copy")


# -- symbols -------------------------------------------------------------------

def pieces(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) -> per conversation and piece of ``PIECE`` rows:
    conv_id, piece, seq (symbols), blank, duplicate, truncated, illegal, turns, least, most.

    Only keys, roles and digests of the texts are shuffled.  The first window
    is keyed by conversation, role and digest, the second streams a conversation
    in order; a piece is collected by its number, so no group is unbounded.
    """
    last = F.right(F.expr(f"trim(TRAILING '{BLANKS}' FROM text)"), F.lit(1))
    slim = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), last.alias("last"))
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    fault = (F.when(F.col("last") == "", "b").when(F.row_number().over(seen) > 1, "d")
             .when(~F.col("last").isin(".", "!", "?"), "t").otherwise("-"))
    marked = slim.select("conv_id", "turn", "role", "digest", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))

    # Of equal rows the duplicates come last.
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest", F.col("fault") == "d")
    pair = F.concat(F.lag("initial").over(order), F.col("initial"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = (F.when(F.col("fault").isin("b", "d"), "X").when(F.col("fault") == "t", F.upper(letter)).otherwise(letter))
    placed = marked.select(
        "conv_id", "turn", "fault", symbol.alias("symbol"), F.row_number().over(order).alias("at"),
        (~pair.isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"))
    return placed.withColumn("piece", F.expr(f"(at - 1) div {PIECE}")).groupBy("conv_id", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "").alias("seq"),
        *[F.count_if(F.col("fault") == f).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
        F.count_if("illegal").alias("illegal"), F.count_if("new_turn").alias("turns"),
        F.min("turn").cast("long").alias("least"), F.max("turn").cast("long").alias("most"))


def codes_of(seqs: list[str]) -> np.ndarray:
    """Symbols of all sequences as numbers, -1 after each sequence."""
    text = np.frombuffer(("\n".join([*seqs, ""])).encode("ascii"), np.uint8)
    table = np.full(256, -1, np.int64)
    table[list(BASE.encode())] = np.arange(len(BASE))
    return table[text]


# -- Re-Pair -------------------------------------------------------------------

def first_of_pairs(codes: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Of the positions ``hit`` (where a pair starts) those that do not overlap one taken before: in a
    run of one symbol every second."""
    run = np.concatenate(([True], codes[1:] != codes[:-1]))
    start = np.maximum.accumulate(np.where(run, np.arange(len(codes)), 0))
    same = codes[:-1] == codes[1:]
    return hit & (~same | ((np.arange(len(codes) - 1) - start[:-1]) % 2 == 0))


def pair_table(rules: list[tuple[int, int, int]]) -> np.ndarray:
    """The symbol of every pair of the rules of one round, else -1.  Its last row and column are
    those of the separator and of any symbol made later."""
    size = max(max(r) for r in rules) + 1
    table = np.full((size + 1, size + 1), -1, np.int64)
    for a, b, made in rules:
        table[a, b] = made
    return table


def replace_pairs(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``codes`` with the pairs of one round replaced; its rules share no symbol, so
    their order does not matter."""
    if len(codes) < 2:
        return codes
    at = np.where(codes < len(table), codes, -1)
    new = table[at[:-1], at[1:]]
    take = first_of_pairs(codes, new >= 0)
    out = codes.copy()
    out[:-1][take] = new[take]
    return out[~np.concatenate(([False], take))]


def compress(seqs: list[str], tables: list[np.ndarray]) -> list[np.ndarray]:
    """The sequences in the grammar's symbols."""
    codes = codes_of(seqs)
    for table in tables:
        codes = replace_pairs(codes, table)
    ends = np.flatnonzero(codes == -1)
    return [codes[a:b] for a, b in zip(np.concatenate(([0], ends[:-1] + 1)), ends, strict=True)] if seqs else []


def compressed(batches: Iterator[pa.RecordBatch], rounds: list[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
    """(conv_id, piece, seq) -> conv_id, piece, codes."""
    tables = [pair_table(r) for r in rounds]
    for batch in batches:
        codes = compress(batch.column("seq").to_pylist(), tables)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array(codes, pa.list_(pa.int64()))],
                                         names=["conv_id", "piece", "codes"])


def pair_counts(batches: Iterator[pa.RecordBatch], rounds: list[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
    """(seq) -> a, b, n: adjacent symbols under the rules so far, one row per pair and task."""
    total: dict[tuple[int, int], int] = {}
    tables = [pair_table(r) for r in rounds]
    for batch in batches:
        codes = codes_of(batch.column("seq").to_pylist())
        for table in tables:
            codes = replace_pairs(codes, table)
        if len(codes) < 2:
            continue
        take = first_of_pairs(codes, (codes[:-1] >= 0) & (codes[1:] >= 0))
        size = int(codes.max()) + 1
        keys, n = np.unique(codes[:-1][take] * size + codes[1:][take], return_counts=True)
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            pair = divmod(k, size)
            total[pair] = total.get(pair, 0) + c
    yield pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in total], pa.int64()), pa.array([p[1] for p in total], pa.int64()),
         pa.array(list(total.values()), pa.int64())], names=["a", "b", "n"])


def _counted(seqs: DataFrame, rounds: list[list[tuple[int, int, int]]]) -> DataFrame:
    return seqs.mapInArrow(lambda it: pair_counts(it, rounds), "a long, b long, n long")


def learn_rules(seqs: DataFrame, max_rules: int = MAX_RULES, a_round: int = RULES_A_ROUND,
                max_rounds: int = ROUNDS) -> list[list[tuple[int, int, int]]]:
    """Rules (left, right, symbol) by round, from ``seqs`` (seq).

    A round takes the most frequent pairs that share no symbol, ties by the
    symbols.  Symbols that no rule names stay as they are, so the bounds on
    rules and rounds lose nothing.
    """
    rounds: list[list[tuple[int, int, int]]] = []
    made = len(BASE)
    while len(rounds) < max_rounds and made - len(BASE) < max_rules:
        counts = _counted(seqs, list(rounds)).groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1").collect()  # at most one row per pair of symbols
        rules, used = [], set()
        for row in sorted(counts, key=lambda r: (-r["n"], r["a"], r["b"])):
            if len(rules) < a_round and made - len(BASE) < max_rules and not used & {row["a"], row["b"]}:
                rules.append((row["a"], row["b"], made))
                used |= {row["a"], row["b"]}
                made += 1
        if not rules:
            break
        rounds.append(rules)
    return rounds


# -- min-plus matrices ---------------------------------------------------------

def _insertions(state: int) -> list[tuple[int, str]]:
    """(state reached, audit) by no, one or two insertions; more come back to a state at a cost."""
    out = [(state, "")]
    for _ in range(2):
        state = NEXT[state]
        if state not in [s for s, _ in out]:
            out.append((state, out[-1][1] + "I"))
    return out


def base_matrix(symbol: str) -> list[list[tuple[int, str] | None]]:
    """Best (cost, audit) from state to state: insertions, then one edit of the row."""
    out: list[list[tuple[int, str] | None]] = [[None] * STATES for _ in range(STATES)]
    low, more = symbol.lower(), TRUNCATED if symbol in "SUAO" else 0
    for start in range(STATES):
        for mid, inserted in _insertions(start):
            steps = [(mid, DELETE, "D")]
            if symbol != "X":
                steps.append((NEXT[mid], REROLE + more, "R"))
                if mid in KEEP_TO.get(low, {}):
                    steps.append((KEEP_TO[low][mid], more, "K"))
            for end, cost, edit in steps:
                found = (INSERT * len(inserted) + cost, inserted + edit)
                if out[start][end] is None or found < out[start][end]:
                    out[start][end] = found
    return out


class Grammar:
    """Rules with their matrices.

    ``cost[symbol][i][j]`` is the least cost from state i to state j or None;
    ``rope[symbol][i][j]`` is the audit text of a base symbol, or the middle
    state of a rule.
    """

    def __init__(self, rounds: list[list[tuple[int, int, int]]]):
        self.rounds = rounds
        self.parts: list[tuple[int, int] | None] = [None] * len(BASE)
        self.cost, self.rope = [], []
        for symbol in BASE:
            matrix = base_matrix(symbol)
            self.cost.append([[e[0] if e else None for e in row] for row in matrix])
            self.rope.append([[e[1] if e else None for e in row] for row in matrix])
        for rules in rounds:
            for a, b, made in rules:
                assert made == len(self.parts)
                self.parts.append((a, b))
                self._multiply(a, b)

    def _multiply(self, a: int, b: int) -> None:
        cost: list[list[int | None]] = [[None] * STATES for _ in range(STATES)]
        mids: list[list[int | None]] = [[None] * STATES for _ in range(STATES)]
        for i in range(STATES):
            for j in range(STATES):
                for m in range(STATES):
                    x, y = self.cost[a][i][m], self.cost[b][m][j]
                    if x is None or y is None:
                        continue
                    c = x + y
                    if cost[i][j] is None or c < cost[i][j] or c == cost[i][j] and _before(
                            self.letters([(a, i, m), (b, m, j)]), self.letters([(a, i, mids[i][j]), (b, mids[i][j], j)])):
                        cost[i][j], mids[i][j] = c, m
        self.cost.append(cost)
        self.rope.append(mids)

    def letters(self, path: list[tuple[int, int, int]]) -> Iterator[str]:
        """The audit of a path of (symbol, state before, state after), text by text."""
        stack = path[::-1]
        while stack:
            symbol, i, j = stack.pop()
            at = self.rope[symbol][i][j]
            if self.parts[symbol] is None:
                yield from at
            else:
                left, right = self.parts[symbol]
                stack.append((right, at, j))
                stack.append((left, i, at))

    def best(self, codes: list[int]) -> tuple[int, str]:
        """Least cost and its ASCII-least audit for a sequence in the grammar's symbols."""
        # A state's path is a linked list of steps, newest first; paths of equal cost are compared by
        # their letters from where they part.
        now: dict[int, tuple[int, tuple | None]] = {START: (0, None)}
        for symbol in codes:
            matrix, step = self.cost[symbol], {}
            for i, (done, path) in now.items():
                for j in range(STATES):
                    if (more := matrix[i][j]) is None:
                        continue
                    found = (done + more, ((symbol, i, j), path))
                    if j not in step or found[0] < step[j][0] or found[0] == step[j][0] and _before(
                            *map(self.letters, _apart(found[1], step[j][1]))):
                        step[j] = found
            now = step
        ends = []
        for i, (done, path) in now.items():
            for j, inserted in _insertions(i):
                if j in ACCEPT:
                    ends.append((done + INSERT * len(inserted), path, inserted))
        least = min(e[0] for e in ends)
        return least, min("".join(self.letters(_unlink(path))) + inserted for c, path, inserted in ends if c == least)


def _unlink(path: tuple | None) -> list[tuple[int, int, int]]:
    out = []
    while path is not None:
        step, path = path
        out.append(step)
    return out[::-1]


def _apart(x: tuple | None, y: tuple | None) -> tuple[list, list]:
    """The steps of two paths of equal length after their last common step."""
    left, right = [], []
    while x is not y:
        left.append(x[0])
        right.append(y[0])
        x, y = x[1], y[1]
    return left[::-1], right[::-1]


def _before(x: Iterator[str], y: Iterator[str]) -> bool:
    """Whether the letters of ``x`` come before those of ``y``."""
    for a in x:
        b = next(y, None)
        if b is None:
            return False
        if a != b:
            return a < b
    return next(y, None) is not None


# -- applying ------------------------------------------------------------------

class _Rewriter:
    """Hash of a conversation's repaired rows, fed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first = audit, 0, START, True
        self.sha = hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False

    def insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._add("")
            self.at += 1

    def _add(self, text: str) -> None:
        self.state = NEXT[self.state]
        self._put("assistant" if self.state == 3 else "user", text)

    def row(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEP_TO[role[0]][self.state]
            self._put(role, text)
        elif edit == "R":
            self._add(text)


def rewrite(batches: Iterator[pa.RecordBatch], rounds: list[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation: a mark of the conversation (kind 0), its pieces (1), its rows (2)
    -> conv_id, cost, audit, repaired_sha256, one row per conversation."""
    grammar = Grammar(rounds)
    known: dict[tuple[int, ...], tuple[int, str]] = {}
    conv, codes, cost, audit, rewriter, open_ = None, [], 0, "", None, False
    out: list[tuple] = []

    def solve() -> tuple[int, str]:
        key = tuple(codes)
        if key in known:
            return known[key]
        found = grammar.best(codes)
        if len(key) <= 64 and len(known) < 65536:  # the short sequences are the ones that many conversations share
            known[key] = found
        return found

    def close() -> None:
        nonlocal rewriter, cost, audit
        if rewriter is None:
            cost, audit = solve()
            rewriter = _Rewriter(audit)
        rewriter.insertions()
        out.append((conv, cost, audit, rewriter.sha.hexdigest()))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
             pa.array(columns[3], pa.string())], names=["conv_id", "cost", "audit", "repaired_sha256"])

    kind = None
    for batch in batches:
        kind = batch.column("conv_id").type
        for key, what, role, text, part in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "codes")), strict=True):
            if what == 0:
                if open_:
                    close()
                conv, codes, rewriter, open_ = key, [], None, True
            elif what == 1:
                codes.extend(part)
            else:
                if rewriter is None:
                    cost, audit = solve()
                    rewriter = _Rewriter(audit)
                rewriter.row(role, text)
        if out:
            yield flush()
    if open_:
        close()
        yield flush()


def repair(rows: DataFrame) -> DataFrame:
    """Cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text).

    Rows by turn, nulls first.  A row's first fault counts: blank (no
    ``[^\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier), truncated
    (the last such character is none of ``.!?``).  Edits: Keep 0; Rerole to user
    or assistant 3; Delete 4, which blank and duplicate rows need; Insert an
    empty user or assistant turn 3; a truncated row that stays adds 3.  Returns
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (initials
    of the edits) and repaired_sha256 for every conversation that has rows.
    """
    return _repair(rows, rows.select("conv_id").distinct())


def _repair(rows: DataFrame, keys: DataFrame) -> DataFrame:
    cut = shared_table(pieces(rows), "pieces")
    rounds = learn_rules(shared_table(cut.select("seq").distinct(), "sequences"))

    key = rows.schema["conv_id"].dataType.simpleString()
    read = cut.select("conv_id", F.col("piece").cast("long").alias("piece"), "seq").mapInArrow(
        lambda it: compressed(it, rounds), f"conv_id {key}, piece long, codes array<long>")
    stream = (keys.select("conv_id", F.lit(0).alias("kind"))
              .unionByName(read.withColumn("kind", F.lit(1)), allowMissingColumns=True)
              .unionByName(rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "text", F.sha2("text", 256).alias("digest")),
                           allowMissingColumns=True))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stream.repartition(parts, "conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "kind", "piece", F.col("turn").asc_nulls_first(), "role", "digest")
    done = dealt.select("conv_id", "kind", "role", "text", "codes").mapInArrow(
        lambda it: rewrite(it, rounds), f"conv_id {key}, cost long, audit string, repaired_sha256 string")

    counts = cut.groupBy(F.col("conv_id").alias("key")).agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    return done.join(counts, F.col("conv_id").eqNullSafe(F.col("key")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")],
        "cost", "audit", "repaired_sha256")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The damaged conversations repaired, one row for every original key; one whose rows
    were all dropped has zeros, an empty audit and the hash of nothing."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    return _repair(damage(rows), rows.select("conv_id").distinct())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLE_SQL: dict[str, str] = {}
