"""Operator 1: token counts by a finite-state transducer.

The tokenizer is compiled to a deterministic transducer over bytes. The token
that ends a prefix's encoding is unique, so a state is the list of suffixes that
may still grow into a token (trie node, the token before it, tokens emitted up to
it), and a transition carries the change in the number of emitted tokens. States
and transitions are made when first needed and kept per worker.

Every text is a run of chunks. A chunk's state map is constant after the first place
where a pre-token begins whatever came before (a change of letters, numbers and other
characters, or a space between two of them), so it is held as (head, count, tail): the
head is read from the state that the chunk is entered in, the count is of what lies
between, the tail is what the state at the end has read. A text's first chunk is entered
in the start state and its last one ends it, so these have no open head or tail. Maps
compose associatively and are joined by a prefix scan; blocks of chunks of one text are
counted in different tasks. Only a run of one kind of character over whole chunks keeps
its text open, as one pre-token's merges may reach over all of it.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import bounded_batches
from .textarrays import WordTable, certain_starts, look_up_texts
from .vocabulary import JsonVocabulary, json_vocabulary

#: Characters in a chunk, and in a block of chunks, which one task joins at the first level of the scan.
CHUNK_CHARS, BLOCK_CHARS = 32_768, 32 * 32_768


class Transducer:
    """Counts the tokens of single pre-tokens; states are numbers, ``step[state][byte]`` is (state, change)."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 300_000):
        self.ranks, self.most_states = ranks, most_states
        self.word = {i: t for t, i in ranks.items()}
        self.nodes: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            if len(token) == 1 or self._merge(token) == [i]:
                node = 0
                for b in token:
                    new = self.nodes[node].get(b)
                    if new is None:
                        new = self.nodes[node][b] = len(self.nodes)
                        self.nodes.append({})
                        self.token_at.append(-1)
                    node = new
                self.token_at[node] = i
        self.follows: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.names: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.step: list[dict[int, tuple[int, int]]] = []
        self._state(((0, -1, 0),))

    def _state(self, key: tuple) -> int:
        s = self.names.get(key)
        if s is None:
            s = self.names[key] = len(self.keys)
            self.keys.append(key)
            self.step.append({})
        return s

    def _merge(self, text: bytes) -> list[int]:
        """Byte pair merging, lowest rank first; for the short strings of the compilation."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: merging their bytes gives just the two again."""
        if a < 0:
            return True
        k = (a << 32) | b
        found = self.follows.get(k)
        if found is None:
            if len(self.follows) > 4 * self.most_states:
                self.follows.clear()
            found = self.follows[k] = self._merge(self.word[a] + self.word[b]) == [a, b]
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        live, last, change = [], -1, 0
        for node, before, emitted in self.keys[state]:
            child = self.nodes[node].get(byte)
            if child is not None:
                live.append((child, before, emitted))
                token = self.token_at[child]
                if last < 0 and token >= 0 and self._fits(before, token):
                    last, change = token, emitted + 1
        key = (*((n, b, e - change) for n, b, e in live if self.nodes[n]), (0, last, 0))
        out = self._state(key), change
        self.step[state][byte] = out
        return out

    def count(self, word: bytes) -> int:
        if len(self.keys) > self.most_states:
            self._clear()
        state = total = 0
        for b in word:
            found = self.step[state].get(b)
            state, change = found if found is not None else self._compile(state, b)
            total += change
        return total


class Counter:
    def __init__(self, vocabulary: JsonVocabulary):
        self.vocabulary = vocabulary
        self.marks = dict.fromkeys(vocabulary.special, 1)
        if vocabulary.plain:
            self.machine = Transducer(vocabulary.ranks)
            self.table = WordTable(lambda words: [(self.machine.count(w.encode("utf-8", "surrogatepass")),) for w in words])

    def counts(self, texts: list[str]) -> list[int]:
        if not self.vocabulary.plain:
            return [len(x) for x in self.vocabulary.encode(texts)]
        return [int(x.sum()) for x in look_up_texts(self.table, texts, self.marks)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(json_vocabulary(path))


# --- chunks -------------------------------------------------------------------


def chunks_of(text: str, size: int = CHUNK_CHARS) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [""]


def state_maps(chunks: list[tuple[str, bool, bool]], count, special: list[str] = ()) -> list[tuple[str, int, str | None]]:
    """(head, count, tail) of each (chunk, is first, is last); a chunk without a certain start is (chunk, 0, None)."""
    out: list = []
    middles: list[str] = []
    for chunk, first, last in chunks:
        at = certain_starts(chunk, special) if not (first and last) else ()
        if not first and not last and len(at) == 0 or first != last and len(at) == 0:
            out.append([chunk, 0, None])
            continue
        a, b = 0 if first else int(at[0]), len(chunk) if last else int(at[-1])
        out.append([chunk[:a], len(middles), chunk[b:]])
        middles.append(chunk[a:b])
    found = count(middles)
    return [(h, found[n] if t is not None else 0, t) for h, n, t in out]


def compose(pairs: list[tuple], count) -> list[tuple]:
    """Each pair of neighbouring maps as one map."""
    joints = count([a[2] + b[0] for a, b in pairs if a[2] is not None and b[2] is not None])
    out, k = [], 0
    for (h1, n1, t1), (h2, n2, t2) in pairs:
        if t1 is None:
            out.append((h1 + h2, n2, t2))
        elif t2 is None:
            out.append((h1, n1, t1 + h2))
        else:
            out.append((h1, n1 + joints[k] + n2, t2))
            k += 1
    return out


def scan(maps: list[tuple], count) -> tuple:
    """All maps as one, by rounds over neighbouring pairs."""
    while len(maps) > 1:
        odd = maps[len(maps) & ~1 :]
        maps = compose(list(zip(maps[::2], maps[1::2], strict=False)), count) + odd
    return maps[0]


def total(one: tuple, count) -> int:
    head, n, tail = one
    return n + sum(count([head] if tail is None else [head, tail]))


def block_maps(blocks: list[tuple[str, bool, bool]], counter_: Counter, size: int = CHUNK_CHARS) -> list[tuple]:
    """The map of each (block, is first, is last): its chunks' maps, counted all together, and scanned."""
    cut = [chunks_of(text, size) for text, _, _ in blocks]
    flat = [(c, first and j == 0, last and j == len(own) - 1) for (_, first, last), own in zip(blocks, cut, strict=True) for j, c in enumerate(own)]
    maps, out, at = state_maps(flat, counter_.counts, list(counter_.marks)), [], 0
    for own in cut:
        out.append(scan(maps[at : at + len(own)], counter_.counts))
        at += len(own)
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), a row per row of ``docs``.

    A null text counts as empty: no bytes, no tokens. Ids may be null or repeat; every
    row is counted for itself. Texts of any length are counted whole, an empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    path, kind = tokenizer_path, docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    id_type = to_arrow_type(kind)
    base = [("row", pa.int64()), ("id", id_type), ("n_bytes", pa.int64()), ("block", pa.int64()), ("last", pa.bool_())]
    cut_schema = pa.schema([*base, ("text", pa.string())])
    map_names = [n for n, _ in base] + ["head", "n", "tail"]
    ddl = f"row long, id {kind.simpleString()}, n_bytes long, block long, last boolean"

    def one_block(batches):
        for batch in batches:
            maps = block_maps([(t, True, True) for t in batch.column("text").to_pylist()], counter(path))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array([total(m, counter(path).counts) for m in maps], pa.int64())], ["id", "n_bytes", "n_tokens"])

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.select(["row", "id", "n_bytes"]).to_pylist(), batch.column("text").to_pylist(), strict=True):
                blocks = range(0, len(text), BLOCK_CHARS)
                for k, a in enumerate(blocks):
                    yield pa.RecordBatch.from_pylist([row | {"block": k, "last": k == len(blocks) - 1, "text": text[a : a + BLOCK_CHARS]}], cut_schema)

    def read(batches):
        for batch in batches:
            flags = zip(batch.column("text").to_pylist(), batch.column("block").to_pylist(), batch.column("last").to_pylist(), strict=True)
            maps = block_maps([(t, k == 0, last) for t, k, last in flags], counter(path))
            found = [pa.array([m[i] for m in maps], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n, _ in base), *found], map_names)

    def join(group: pa.Table) -> pa.Table:
        count = counter(path).counts
        group = group.sort_by("block")
        one = scan(list(zip(*(group.column(c).to_pylist() for c in ("head", "n", "tail")), strict=True)), count)
        return pa.table([group.column("id").slice(0, 1), group.column("n_bytes").slice(0, 1), pa.array([total(one, count)], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    done = f"id {kind.simpleString()}, n_bytes long, n_tokens long"
    short = rows.filter(F.length("text") <= BLOCK_CHARS).mapInArrow(one_block, done)
    long = (
        rows.filter(F.length("text") > BLOCK_CHARS)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut, f"{ddl}, text string")
        .repartition("row", "block")
        .mapInArrow(read, f"{ddl}, head string, n long, tail string")
        .groupBy("row")
        .applyInArrow(join, done)
    )
    return short.unionByName(long).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
