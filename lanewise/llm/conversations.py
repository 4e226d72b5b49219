"""Repair of conversations' structure by a rank-convergence parallel Viterbi: chunks of turns start from speculative cost
vectors, fix-up passes rerun them until vectors differ only by constants, and the stitched backward costs drive the
tracing of the least audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stage, unstage

#: Rows in a chunk; fix-up passes before chunks that still don't converge are composed as matrices.
CHUNK, PASSES = 4096, 4
#: Initials of roles by their number; the state asks for _WANT and then is _AFTER. States: nothing said, system said, user
#: said, assistant said.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
_WANT, _AFTER, _NEXT = (USER, USER, ASSISTANT, USER), (2, 2, 3, 2), {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (3, USER): 2, (2, ASSISTANT): 3}
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Backward costs after the last row, and what a chunk starts from that doesn't know its successor's.
FINAL, GUESS, FAR = (0, 4, 2, 0), (0, 0, 0, 0), 1 << 40
_SPACE = " \t\n\x0b\x0c\r"


class Viterbi:
    """Costs and moves of rows. A row's code is its initial, plus 4 if it is cut off, plus 8 if it must go. Vectors that
    differ by a constant are one (of least entry 0), so there are few, and a step is a look into a table."""

    def __init__(self):
        self.steps: dict = {}
        self.moves: dict = {}

    def options(self, state: int, code: int, after: tuple) -> list[tuple[int, str, int | None, int]]:
        """cost to the end, letter, new role and next state of what may become of a row, without insertions."""
        cut, initial = CUT * (code >> 2 & 1), code & 3
        out = [(DELETE + after[state], "D", None, state), (REROLE + cut + after[_AFTER[state]], "R", _WANT[state], _AFTER[state])]
        if (state, initial) in _NEXT:
            out.append((KEEP + cut + after[_NEXT[state, initial]], "K", None, _NEXT[state, initial]))
        return out

    def costs(self, code: int, after: tuple) -> tuple:
        """Costs before the row, insertions included."""
        c = [min(self.options(state, code, after))[0] for state in range(4)]
        said, told = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
        return min(c[0], INSERT + said), min(c[1], INSERT + said), said, told

    def step(self, code: int, after: tuple) -> tuple[tuple, int]:
        known = self.steps.get((code, after))
        if known is None:
            before = self.costs(code, after)
            least = min(before)
            known = self.steps[code, after] = tuple(min(b - least, FAR) for b in before), least
        return known

    def back(self, codes: list[int], runs: list[int], vector: tuple, kept: list | None = None) -> tuple[tuple, int]:
        """The vector before the chunk, and the constant that it has left. kept gets the vectors after the rows, last first."""
        total = 0
        for code, n in zip(reversed(codes), reversed(runs)):
            if kept is not None:
                kept.append(vector)
            if code & 8:
                total += DELETE * n
                continue
            vector, more = self.step(code, vector)
            total += more + DELETE * (n - 1)
        return vector, total

    def again(self, codes: list[int], vector: tuple, old: tuple, out: tuple, total: int) -> tuple[tuple, int]:
        """back() from another vector, given what `old` led to: over once the two differ by a constant."""
        ahead = 0
        for code in reversed(codes):
            if vector == old:
                return out, total + ahead
            if not code & 8:
                (vector, more), (old, less) = self.step(code, vector), self.step(code, old)
                ahead += more - less
        return vector, total + ahead

    def move(self, state: int, code: int, after: tuple) -> tuple[str, tuple, int]:
        """Letters, inserted roles with the row's new role last (None: as it is; absent: deleted), and the next state: of the
        cheapest ways the one whose letters come first."""
        known = self.moves.get((state, code, after))
        if known is None:
            before, at, letters, roles = self.costs(code, after), state, "", ()
            while True:
                best = {letter: (role, to) for cost, letter, role, to in self.options(at, code, after) if cost == before[at]}
                if "D" not in best and INSERT + before[_AFTER[at]] == before[at]:
                    letters, roles, at = letters + "I", (*roles, _WANT[at]), _AFTER[at]
                    continue
                letter = min(best)
                role, at = best[letter]
                known = self.moves[state, code, after] = letters + letter, roles if letter == "D" else (*roles, role), at
                break
        return known

    def trace(self, codes: list[int], runs: list[int], vectors: list[tuple], state: int, seqs: list[int] | None = None, said: list | None = None) -> tuple[list[str], int]:
        """Letters by row, and the state after them; said gets (seq, place, new role, is the row itself) of what is left."""
        letters = []
        for k, (code, n) in enumerate(zip(codes, runs)):
            if code & 8:
                letters.append("D" * n)
                continue
            some, roles, state = self.move(state, code, vectors[-1 - k])
            letters.append(some + "D" * (n - 1))
            if said is not None:
                own = len(roles) - (some[-1] != "D")
                said += [(seqs[k], at, ROLES.get(role), at == own) for at, role in enumerate(roles)]
        return letters, state


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by CRC-32 of "<conv_id>:<turn>" modulo 20: 0 drops a row, 1 empties its text, 2 takes out its
    full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls count as one space there; a null
    role or text becomes one."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(some("text"), ".!?", "")).otherwise(some("text"))
    rows = conversations.withColumn("_fate", fate).filter("_fate != 0")
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.when(fate == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) in one order over all tasks: seq, with n equal rows as one, the rows' codes
    and faults. Equal rows are counted before they are shuffled; no task gets a whole conversation."""
    named = rows.withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    merged = named.groupBy("_conv", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    merged = merged.withColumn("_same", F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256))
    seen = merged.groupBy("_conv", "_same").agg(F.count("*").alias("_m"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_first")).filter("_m > 1").select("_conv", "_same", F.col("_first.turn").alias("_turn"), F.lit(True).alias("_more"))
    met = merged.join(seen, ["_conv", "_same"], "left")
    first = F.col("_more").isNull() | F.col("turn").eqNullSafe(F.col("_turn"))
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    blank = end == ""
    cut = ~F.substring(end, -1, 1).isin(".", "!", "?")
    initial = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in "sua"]), F.substring("role", 1, 1)), F.lit(0))
    code = F.when(initial == 0, OTHER).otherwise(initial - 1) + F.when(blank | ~first, 8).when(cut, 4).otherwise(0)
    faults = [F.when(blank, F.col("n")).otherwise(0).alias("blank"), F.when(blank, 0).when(first, F.col("n") - 1).otherwise(F.col("n")).alias("duplicate"), (~blank & first & cut).cast("bigint").alias("truncated")]
    order = ["_conv", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = met.select("_conv", "turn", "role", "text", "n", code.cast("int").alias("code"), *faults).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.withColumn("seq", F.monotonically_increasing_id())


def _chunk_kernel(of, names: list[str], schema: str):
    """mapInArrow over (_conv, chunk, rows, and `names`): of(viterbi, seqs, codes, runs, *values) gives the rest of a row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = Viterbi()
        for one in batches:
            lists, out = one.column(2), []
            parts = [lists.flatten().field(k).to_pylist() for k in range(3)]
            at = (np.asarray(lists.offsets) - lists.offsets[0].as_py()).tolist()
            rest = [one.column(3 + k).to_pylist() for k in range(len(names))]
            for k in range(one.num_rows):
                out.append(of(viterbi, *(p[at[k] : at[k + 1]] for p in parts), *(r[k] for r in rest)))
            columns = [pa.array(c, t.type) for c, t in zip(zip(*out), list(kind)[2:])] if out else [pa.array([], t.type) for t in list(kind)[2:]]
            yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), *columns], schema=kind)

    return lambda df: df.select("_conv", "chunk", "rows", *names).mapInArrow(run, schema)


_EDGE = "_conv string, chunk long, vin array<int>, vout array<int>, total long"


def _speculate(viterbi, seqs, codes, runs, last):
    vector = FINAL if last else GUESS
    out, total = viterbi.back(codes, runs, vector)
    return vector, out, total


def _fix(viterbi, seqs, codes, runs, new, old, out, total):
    out, total = viterbi.again(codes, tuple(new), tuple(old), tuple(out), total)
    return new, out, total


def _restart(viterbi, seqs, codes, runs, new):
    return new, *viterbi.back(codes, runs, tuple(new))


def _matrix(viterbi, seqs, codes, runs):
    """What the chunk makes of the four vectors that know one state each, row by row of a 4 x 4 matrix."""
    made = []
    for k in range(4):
        out, total = viterbi.back(codes, runs, tuple(0 if s == k else FAR for s in range(4)))
        made.append([min(total + x, FAR) for x in out])
    return ([made[k][s] for s in range(4) for k in range(4)],)


def _plus(a: Column, b: Column) -> Column:
    """The product of two such matrices: sums for products, minima for sums."""
    entry = lambda e: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(a, F.floor(e / 4).cast("int") * 4 + k) + F.get(b, k * 4 + e % 4)))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda e: F.least(entry(e), F.lit(FAR)))


def _doubled(table: DataFrame, value: str, step: int, joined) -> DataFrame:
    """value of every row (_conv, idx) composed with those of all rows before it (step -1) or after it (1): each round reaches
    twice as far, so rounds are a logarithm of a conversation's chunks. Keys are single chunks; none is hot."""
    reach, most = 1, table.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0]
    now = stage(table.select("_conv", "idx", value), "conversations-doubled")
    while reach < most:
        other = now.select("_conv", (F.col("idx") - step * reach).alias("idx"), F.col(value).alias("_other"))
        new = stage(now.join(other, ["_conv", "idx"], "left").select("_conv", "idx", F.when(F.col("_other").isNull(), F.col(value)).otherwise(joined(F.col(value), F.col("_other"))).alias(value)), "conversations-doubled")
        unstage(now)
        now, reach = new, reach * 2
    return now


def _converged(chunks: DataFrame, passes: int) -> DataFrame:
    """vin, vout and total of every chunk, exact: vin is the vector after the chunk less its least entry.

    Chunks that aren't their conversation's last start from a guess. A pass reruns those whose successor's vector has turned
    out another, until the old and the new one differ only by a constant. Where turns don't converge (a run of one role keeps
    its parity for ever), `passes` passes are followed by composing the chunks' matrices, so rounds stay few."""
    edges = stage(_chunk_kernel(_speculate, ["last"], _EDGE)(chunks.withColumn("last", F.col("next").isNull())), "conversations-edges")
    if not chunks.filter("next IS NOT NULL").limit(1).count():
        return edges
    links = chunks.filter("next IS NOT NULL").select("_conv", "chunk", "next")
    rows = chunks.select("_conv", "chunk", "rows")

    def wrong() -> DataFrame:
        theirs = edges.select("_conv", F.col("chunk").alias("next"), F.col("vout").alias("new"))
        return links.join(theirs, ["_conv", "next"]).select("_conv", "chunk", "new").join(edges, ["_conv", "chunk"]).filter("vin != new")

    def put(fixed: DataFrame) -> DataFrame:
        new = stage(fixed, "conversations-fixed")
        out = stage(edges.join(new, ["_conv", "chunk"], "left_anti").unionByName(new), "conversations-edges")
        unstage(edges, new)
        return out

    for _ in range(passes):
        todo = stage(wrong(), "conversations-todo")
        if not todo.limit(1).count():
            return edges
        edges = put(_chunk_kernel(_fix, ["new", "vin", "vout", "total"], _EDGE)(todo.join(rows, ["_conv", "chunk"])))
        unstage(todo)
    ids = wrong().select("_conv").distinct()
    left = stage(chunks.join(ids, "_conv", "left_semi"), "conversations-left")
    if not left.limit(1).count():
        return edges
    matrices = _chunk_kernel(_matrix, [], "_conv string, chunk long, m array<long>")(left).join(left.select("_conv", "chunk", "idx"), ["_conv", "chunk"])
    suffix = _doubled(matrices, "m", 1, _plus)
    vector = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get("m", s * 4 + k) + F.get(F.array(*map(F.lit, FINAL)), k))))
    after = suffix.select("_conv", (F.col("idx") - 1).alias("idx"), vector.alias("v")).select("_conv", "idx", F.transform("v", lambda x: (x - F.array_min("v")).cast("int")).alias("new"))
    return put(_chunk_kernel(_restart, ["new"], _EDGE)(left.join(after, ["_conv", "idx"])))


def _tracing(viterbi, seqs, codes, runs, vin, start, last):
    """Start None: the state that each of the four leads to. Else the chunk's letters and what is said."""
    vectors: list[tuple] = []
    viterbi.back(codes, runs, tuple(vin), vectors)
    if start is None:
        return [viterbi.trace(codes, runs, vectors, s)[1] for s in range(4)], None, None
    said: list = []
    letters, state = viterbi.trace(codes, runs, vectors, start, seqs, said)
    place = 1 << 20
    while last and state in (1, 2):
        letters.append("I")
        said.append((seqs[-1], place, ROLES[_WANT[state]], False))
        state, place = _AFTER[state], place + 1
    return None, "".join(letters), [dict(zip(("seq", "place", "role", "own"), x)) for x in said]


_TRACED = "_conv string, chunk long, ends array<int>, letters string, said array<struct<seq:long,place:int,role:string,own:boolean>>"


class Repair:
    """The repair of conversations: rows (conv_id, turn, role, text) and, if there, copies.

    Rows are taken by turn (null turns first), of one turn by role and text; n equal rows are one row and n - 1 duplicates.
    Null roles and texts count as one space; null conv_ids are one conversation. A chunk has `chunk` rows at most (a power of
    two), however long its conversation is; only the numbers of a conversation's chunks pass through one task together.
    """

    def __init__(self, rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES):
        lean(rows.sparkSession)
        some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        copies = F.col("copies").cast("bigint") if "copies" in rows.columns else F.lit(1).cast("bigint")
        self.rows = stage(_ordered(rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), some("role"), some("text"), copies.alias("copies"))), "conversations-rows")
        listed = self.rows.groupBy("_conv", F.expr(f"seq div {chunk}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("seq", "code", "n"))).alias("rows"))
        plain = stage(listed, "conversations-listed")
        by = Window.partitionBy("_conv").orderBy("chunk")
        head = F.get("rows", F.lit(0))["code"] % 4
        slim = plain.select("_conv", "chunk", head.alias("head")).select("_conv", "chunk", F.lead("chunk").over(by).alias("next"), F.lead("head").over(by).alias("follows"), F.row_number().over(by).alias("idx"))
        chunks = stage(plain.join(slim, ["_conv", "chunk"]), "conversations-chunks")
        unstage(plain)
        edges = _converged(chunks, passes)
        known = chunks.join(edges.select("_conv", "chunk", "vin", "total", F.get("vout", F.lit(0)).alias("head")), ["_conv", "chunk"])
        trace = _chunk_kernel(_tracing, ["vin", "start", "last"], _TRACED)
        known = stage(known.withColumn("last", F.col("next").isNull()), "conversations-known")
        starts = F.when(F.col("idx") == 1, 0)
        if chunks.filter("next IS NOT NULL").limit(1).count():
            several = known.filter("idx > 1 OR NOT last").withColumn("start", F.lit(None).cast("int"))
            ends = trace(several).join(several.select("_conv", "chunk", "idx"), ["_conv", "chunk"])
            # where the last of chunks 1 to idx ends that starts where the first one does
            prefix = _doubled(ends, "ends", -1, lambda later, earlier: F.transform(earlier, lambda s: F.get(later, s)))
            begun = prefix.select("_conv", (F.col("idx") + 1).alias("idx"), F.get("ends", F.lit(0)).alias("_start"))
            traced = known.join(begun, ["_conv", "idx"], "left").withColumn("start", F.coalesce(starts, "_start"))
        else:
            traced = known.withColumn("start", starts)
        self.traced = stage(trace(traced), "conversations-traced")
        self.known = known
        unstage(edges, chunks)

    def summary(self) -> DataFrame:
        """_conv, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation with rows. An audit is one
        string, as long as its conversation has edits."""
        by_turn = self.rows.groupBy("_conv", "turn").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        faults = by_turn.groupBy("_conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        initials = F.transform("rows", lambda x: x["code"] % 4)
        legal = lambda a, b: ((a == SYSTEM) & (b == USER)) | ((a == USER) & (b == ASSISTANT)) | ((a == ASSISTANT) & (b == USER))
        pairs = F.zip_with(F.slice(initials, F.lit(1), F.greatest(F.size("rows") - 1, F.lit(0))), F.slice(initials, F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), lambda a, b: F.when(legal(a, b), 0).otherwise(1))
        inside = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, x: s + x) + F.aggregate("rows", F.lit(0).cast("bigint"), lambda s, x: s + x["n"] - 1)
        across = F.when(F.col("follows").isNull() | legal(F.element_at(initials, -1), F.col("follows")), 0).otherwise(1)
        costs = self.known.groupBy("_conv").agg(F.sum(inside + across).alias("illegal"), (F.sum("total") + F.sum(F.when(F.col("idx") == 1, F.col("head")).otherwise(0))).alias("cost"))
        audits = self.traced.groupBy("_conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "letters"))), lambda x: x["letters"]), "").alias("audit"))
        return faults.join(costs, "_conv").join(audits, "_conv")

    def messages(self) -> DataFrame:
        """The repaired conversations: _conv, seq, place (their order), role and text; an inserted message has an empty text."""
        said = self.traced.select("_conv", F.explode("said").alias("x")).select("_conv", "x.*")
        met = said.join(self.rows.select("seq", F.col("role").alias("_role"), F.col("text").alias("_text")), "seq")
        return met.select("_conv", "seq", "place", F.coalesce("role", "_role").alias("role"), F.when(F.col("own"), F.col("_text")).otherwise("").alias("text"))


def digests(messages: DataFrame) -> DataFrame:
    """_conv and repaired_sha256 of the messages "role:text", joined by newlines. The hash is sequential by its nature: a
    conversation's messages stream through one task in their order, of which a batch at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for one in batches:
            done: list[tuple[str, str]] = []
            for conv, role, text in zip(one.column(0).to_pylist(), one.column(1), one.column(2)):
                if conv != name:
                    if name is not None:
                        done.append((name, state.hexdigest()))
                    name, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role.as_py()}:{text.as_py()}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in range(2)], ["_conv", "repaired_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["_conv", "repaired_sha256"])

    sorted_ = messages.repartition("_conv").sortWithinPartitions("_conv", "seq", "place")
    return sorted_.select("_conv", "role", "text").mapInArrow(run, "_conv string, repaired_sha256 string")


def repair_digest(conversations: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """One row for every conv_id of `conversations` (a null one too), from the repair of `rows`; a conversation that has no
    rows there has zeros, an empty audit and the hash of an empty text."""
    found = Repair(rows, **options)
    met = found.summary().join(digests(found.messages()), "_conv", "left")
    all_ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zero = [F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.join(met, "_conv", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_rank_convergence(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_digest(conversations, damaged(conversations))


_TRIM = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

#: States as numbers: 0 nothing, 1 system, 2 user, 3 assistant said. A prefix's best way into each state is kept: of equal
#: costs the letters that come first. Insertions follow each row (and the start), at most two of them.
OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(CAST(k AS BIGINT), list_transform(range(8), lambda i: CAST(i AS BIGINT))),
                 lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) AS r(k)),
b AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS bytes FROM conversations),
c AS (SELECT conv, turn, role, text, xor(list_reduce(bytes, lambda c, h: xor(c >> 8, t[xor(c & 255, h) + 1])), 4294967295) % 20 AS h FROM b, crc),
d AS (SELECT conv, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM c, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS r(k)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
f AS (SELECT *, {_TRIM} = '' AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 AS again, right({_TRIM}, 1) NOT IN ('.', '!', '?') AS cut,
      left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY k) AS was FROM o),
g AS (SELECT *, blank OR again AS gone, CAST(cut AND NOT blank AND NOT again AS INT) AS late FROM f),
s AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, sum(late) AS truncated,
      count_if(was IS NOT NULL AND was || x NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv),
fill(a, z, cost, letters, said) AS (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']),
     (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
way AS (SELECT conv, 0 AS k, z AS state, {{'cost': fill.cost, 'letters': fill.letters, 'said': CAST(fill.said AS VARCHAR[])}} AS w FROM s, fill WHERE a = 0
 UNION ALL SELECT conv, k, z, min({{'cost': w.cost + fill.cost, 'letters': w.letters || fill.letters, 'said': list_concat(w.said, CAST(fill.said AS VARCHAR[]))}}) FROM (
  SELECT way.conv, g.k, state, {{'cost': w.cost + 3, 'letters': w.letters || 'D', 'said': w.said}} AS w FROM way JOIN g ON g.conv = way.conv AND g.k = way.k + 1
  UNION ALL SELECT way.conv, g.k, CASE WHEN x = 's' THEN 1 WHEN x = 'u' THEN 2 ELSE 3 END, {{'cost': w.cost + late, 'letters': w.letters || 'K', 'said': list_append(w.said, role || ':' || text)}}
   FROM way JOIN g ON g.conv = way.conv AND g.k = way.k + 1 WHERE NOT gone AND ((x = 's' AND state = 0) OR (x = 'u' AND state <> 2) OR (x = 'a' AND state = 2))
  UNION ALL SELECT way.conv, g.k, CASE WHEN state = 2 THEN 3 ELSE 2 END, {{'cost': w.cost + 2 + late, 'letters': w.letters || 'R', 'said': list_append(w.said, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || text)}}
   FROM way JOIN g ON g.conv = way.conv AND g.k = way.k + 1 WHERE NOT gone) JOIN fill ON fill.a = state GROUP BY conv, k, z),
best AS (SELECT way.conv, min(w) AS w FROM way JOIN (SELECT conv, max(k) AS k FROM g GROUP BY conv) e ON e.conv = way.conv AND e.k = way.k WHERE state IN (0, 3) GROUP BY way.conv)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
 CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.cost, 0) AS BIGINT) AS cost, coalesce(w.letters, '') AS audit, sha256(coalesce(array_to_string(w.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv FROM conversations) i LEFT JOIN s ON s.conv = i.conv LEFT JOIN best ON best.conv = i.conv
"""
