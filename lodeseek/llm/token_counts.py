"""Token counts by a compiled finite-state tokenizer.

A BPE segmentation can be read left to right: the last token of a prefix is the one
token that ends there and is compatible with the last token of what precedes it, and
two tokens are compatible if merging their concatenation gives them back. So a state
needs only the longest suffix that some longer piece starts with, and at each place in
it the last token and the number of tokens so far. States and transitions of that
deterministic transducer are compiled when they are first met; each transition is
annotated with the tokens it adds (a merge makes that negative). White space after
anything else, a character outside the vocabulary and a document's start lead to one
state from everywhere.

Texts of a batch are laid end to end and cut into chunks of equal length that run side
by side. A chunk starts in an unknown state, in which only those synchronizing symbols
count, so its state map is: a head that depends on the entry state, then a constant. A
chunk without such a symbol is all head. Of such a chunk the map is kept for the few states
that can reach it: the exits of the chunk before, beginning with the one that a run over the
last characters before it predicts, closed under exits. A state soon forgets what
was before it, so these are one or two. The maps are composed by a parallel prefix
scan (doubling), which gives each chunk's entry state, and counts are prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, tidy
from .words import slices

SPACE = "▁"
#: Columns of the transition table: a document's start, a space that begins or goes on, unknown characters by bytes.
BOS, SPACE_BEGINS, SPACE_GOES_ON, UNKNOWN, FIRST_CHAR = 0, 1, 2, 3, 7
UNSET = -1
CHUNK, TABLE_LIMIT = 512, 1 << 25
#: Characters taken together; a longer text is run in parts, each from the state that the one before leaves. Characters that predict a state.
BATCH, WARM = CHUNK * 4096, 64
#: A transition holds the state it leads to and the tokens it adds, in so many bits.
ADDED_BITS = 6


class CountingTransducer:
    """Compiled from a sentencepiece BPE model with byte fallback, identity normalizer and dummy prefix."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        starts = {p[:k] for p in self.score for k in range(1, len(p))}
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or any(c not in self.score for p in self.score for c in p):
            raise ValueError("pieces with white space inside, or of characters that are no pieces, are not supported")
        self.starts = starts
        few: dict[str, list[str]] = {s: [] for s in starts}
        for piece in self.score:
            for k in range(1, len(piece)):
                few[piece[:k]].append(piece)
        self.longer_pieces = {s: pieces for s, pieces in few.items() if len(pieces) <= 12}
        self._compatible: dict[tuple[str | None, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.n_columns, self.width = FIRST_CHAR, 128
        self.column = np.full(0x110000, UNSET, np.int32)
        self.chars: dict[int, str] = {SPACE_GOES_ON: SPACE}
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.same_last: dict[tuple[str, tuple[str, ...]], str | None] = {}
        self.table = np.full((1024, self.width), UNSET, np.int32)
        self.unknown_entry = self._state(("?", ()))  # 0: the entry state of a chunk
        self.start = self._state(("", ((None, 0),)))
        self.after_space, _ = self._step(self.start, SPACE)

    # compiling

    def _merge(self, text: str) -> list[str]:
        """The pieces of a text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, last: str | None, piece: str) -> bool:
        key = (last, piece)
        known = self._compatible.get(key)
        if known is None:
            known = self._merge((last or "") + piece) == ([piece] if last is None else [last, piece])
            if len(self._compatible) > 500_000:
                self._compatible.clear()
            self._compatible[key] = known
        return known

    def _state(self, key: tuple) -> int:
        found = self.index.get(key)
        if found is None:
            found = self.index[key] = len(self.states)
            self.states.append(key)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, UNSET)])
        return found

    def _step(self, state: int, char: str) -> tuple[int, int]:
        suffix, places = self.states[state]
        longer = suffix + char
        n = len(longer)
        for size in range(n, 0, -1):
            piece = longer[n - size :]
            place = places[n - size]
            if place is not None and piece in self.score and self._fits(place[0], piece):
                last, added = piece, place[1] + 1
                break
        else:
            raise AssertionError("no piece ends here")
        while longer and longer not in self.starts:
            longer = longer[1:]
        kept = places[n - len(longer) :]
        new = tuple(self._place(longer[j:], kept[j], added) for j in range(len(longer)))
        return self._state((longer, (*new, (last, 0)))), added

    def _place(self, begun: str, place: tuple[str | None, int] | None, added: int) -> tuple[str | None, int] | None:
        """What a place must tell: nothing if no piece can get from there; last tokens that admit the same pieces are one."""
        if place is None or begun not in self.starts:
            return None
        last, count = place
        pieces = self.longer_pieces.get(begun)
        if pieces is not None:
            fitting = tuple(p for p in pieces if self._fits(last, p))
            if not fitting:
                return None
            last = self.same_last.setdefault((begun, fitting), last)
        return last, count - added

    def _compile(self, state: int, column: int) -> None:
        if column in (BOS, SPACE_BEGINS):
            to, added = self.after_space, 1
        elif UNKNOWN <= column < FIRST_CHAR:
            to, added = self.start, column - UNKNOWN + 1
        elif state == self.unknown_entry:
            to, added = state, 0
        else:
            to, added = self._step(state, self.chars[column])
        half = 1 << ADDED_BITS - 1
        if not -half <= added < half or to >= 1 << 31 - ADDED_BITS:
            raise OverflowError(f"a transition that adds {added} tokens and leads to state {to} has no room")
        self.table[state, column] = to << ADDED_BITS | added + half

    # running

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        columns = self.column[codes]
        if (columns == UNSET).any():
            for code in np.unique(codes[columns == UNSET]).tolist():
                char = chr(code)
                if code == 32 or char == SPACE:
                    self.column[code] = SPACE_GOES_ON
                elif char not in self.score:
                    self.column[code] = UNKNOWN + len(char.encode()) - 1
                else:
                    self.column[code] = self.n_columns
                    self.chars[self.n_columns] = char
                    self.n_columns += 1
            if self.n_columns > self.width:
                while self.n_columns > self.width:
                    self.width *= 2
                wider = np.full((len(self.table), self.width), UNSET, np.int32)
                wider[:, : self.table.shape[1]] = self.table
                self.table = wider
            columns = self.column[codes]
        return columns

    def _advance(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = self.table.ravel().take(state * self.width + column)
        if (step < 0).any():
            for pair in set(zip(state[step < 0].tolist(), column[step < 0].tolist())):
                self._compile(*pair)
            step = self.table.ravel().take(state * self.width + column)
        return step >> ADDED_BITS, (step & (1 << ADDED_BITS) - 1) - (1 << ADDED_BITS - 1)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; the dummy prefix makes every text that isn't empty start with a space."""
        out = np.zeros(len(texts), np.int64)
        at, room = 0, 0
        for i, text in enumerate(texts):
            if len(text) >= BATCH:
                out[at:i] = self._count_short(texts[at:i])
                out[i], at, room = self._count_long(text), i + 1, 0
                continue
            room += len(text) + 1
            if room >= BATCH:
                out[at : i + 1] = self._count_short(texts[at : i + 1])
                at, room = i + 1, 0
        out[at:] = self._count_short(texts[at:])
        return out

    def _count_short(self, texts: list[str]) -> np.ndarray:
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return np.zeros(len(texts), np.int64)
        columns = self._laid_out("".join(f"\0{t}" for t in texts if t), (ends - sizes)[sizes > 0])
        sums, _ = self._scan(columns, self.unknown_entry)
        return sums[ends] - sums[ends - sizes]

    def _count_long(self, text: str) -> int:
        total, state, before = 0, self.unknown_entry, ""
        for a in range(0, len(text) + 1, BATCH):  # the start is a character more
            part = text[max(a - 1, 0) : a + BATCH - 1]
            if a and len(self.states) * self.width > TABLE_LIMIT:
                key = self.states[state]
                self.reset()
                state = self._state(key)
            if not a:
                columns = self._laid_out("\0" + part, np.zeros(1, np.int64))
            else:
                # the character before tells whether a space goes on
                columns = self._laid_out(before + part, np.zeros(0, np.int64))[len(before) :]
            sums, state = self._scan(columns, state)
            total += int(sums[-1])
            before = text[max(a + BATCH - 3, 0) : a + BATCH - 1]
        return total

    def _laid_out(self, chars: str, begin: np.ndarray) -> np.ndarray:
        """The columns of the characters; at `begin` stands a document's start."""
        if len(self.states) * self.width > TABLE_LIMIT and len(begin):
            self.reset()
        columns = self._columns(np.frombuffer(chars.encode("utf-32-le"), "<u4"))
        space = columns == SPACE_GOES_ON
        columns[1:][space[1:] & ~space[:-1]] = SPACE_BEGINS
        # behind the document's start, which stands for a space, a space goes on
        second = begin[begin + 1 < len(columns)] + 1
        columns[second[columns[second] == SPACE_BEGINS]] = SPACE_GOES_ON
        columns[begin] = BOS
        return columns

    def _scan(self, columns: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Prefix sums of the tokens, and the state at the end (if the columns fill their chunks)."""
        lanes = -(-len(columns) // CHUNK)
        grid = np.full(lanes * CHUNK, SPACE_GOES_ON, np.int32)
        grid[: len(columns)] = columns
        by_step = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
        added = np.empty((CHUNK, lanes), np.int8)
        state = np.full(lanes, self.unknown_entry, np.int64)
        for t in range(CHUNK):  # every chunk from the unknown state: its map's constant part
            state, added[t] = self._advance(state, by_step[t])
        synced = (by_step <= SPACE_BEGINS) | (by_step >= UNKNOWN) & (by_step < FIRST_CHAR)
        head = np.where(synced.any(axis=0), synced.argmax(axis=0), CHUNK)
        head[-1] = min(head[-1], len(columns) - (lanes - 1) * CHUNK)
        sums = np.zeros(len(columns) + 1, np.int64)
        flat = added.T.ravel()[: len(columns)].astype(np.int64)
        flat[::CHUNK] += self._heads(by_step, state, head, entry)  # a head lies within one text
        np.cumsum(flat, out=sums[1:])
        return sums, int(state[-1])

    def _run(self, by_step: np.ndarray, lane: np.ndarray, entry: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state behind, and the tokens of, the steps from first to last of these lanes from these states."""
        order = np.argsort(first - last, kind="stable")  # longest first
        lane, now, first, length = lane[order], entry[order].copy(), first[order], (last - first)[order]
        tokens = np.zeros(len(lane), np.int64)
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, side="left"))
            now[:n], more = self._advance(now[:n], by_step[first[:n] + t, lane[:n]])
            tokens[:n] += more
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], tokens[back]

    def _heads(self, by_step: np.ndarray, state: np.ndarray, head: np.ndarray, entry: int) -> np.ndarray:
        """The tokens of each chunk's head. `state`, of each chunk's exit, is set right for chunks that are all head."""
        n, whole = len(head), head == CHUNK
        before = np.concatenate([[entry], state[:-1]])
        after_whole = np.concatenate([[False], whole[:-1]])  # entered from a chunk that is all head
        out = np.zeros(n, np.int64)
        sure = np.flatnonzero((head > 0) & ~after_whole)
        exits, out[sure] = self._run(by_step, sure, before[sure], np.zeros(len(sure), np.int64), head[sure])
        state[sure[whole[sure]]] = exits[whole[sure]]
        unsure = np.flatnonzero(after_whole)
        if not len(unsure):
            return out
        # maps from few entry states to exit states and tokens, the predicted entry first
        guess, _ = self._run(by_step, unsure - 1, np.full(len(unsure), self.start), np.full(len(unsure), CHUNK - WARM), np.full(len(unsure), CHUNK))
        maps: dict[int, dict[int, tuple[int, int]]] = {i: {} for i in unsure.tolist()}
        asked = set(zip(unsure.tolist(), guess.tolist()))
        asked |= {(i + 1, int(state[i])) for i in sure[whole[sure]].tolist() if i + 1 < n}
        while asked:
            lane, entries = (np.array(x, np.int64) for x in zip(*sorted(asked)))
            exits, tokens = self._run(by_step, lane, entries, np.zeros(len(lane), np.int64), head[lane])
            for i, e, x, k in zip(lane.tolist(), entries.tolist(), exits.tolist(), tokens.tolist()):
                maps[i][e] = x, k
            reached = {(i + 1, x) for i, x in zip(lane.tolist(), exits.tolist()) if whole[i] and i + 1 < n}
            asked = {(i, x) for i, x in reached if x not in maps[i]}
        # prefix scan: to[i] takes the place of an entry among the chunk before's to that of its exit among this one's
        width = max(map(len, maps.values()))
        place = {i: {e: k for k, e in enumerate(m)} for i, m in maps.items()}
        to = np.zeros((n, width), np.int64)
        depth = np.zeros(n, np.int64)  # chunks since the one that was entered from a known state
        for i in unsure.tolist():
            depth[i] = depth[i - 1] + 1
            if depth[i] == 1:
                to[i] = place[i][int(state[i - 1])]
            else:
                to[i, : len(maps[i - 1])] = [place[i][x] for x, _ in maps[i - 1].values()]
        step = 1
        while step < int(depth.max()):
            far = np.flatnonzero(depth > step)
            to[far] = np.take_along_axis(to[far], to[far - step], 1)
            step *= 2
        for i in unsure.tolist():
            exit_state, out[i] = list(maps[i].values())[int(to[i, 0])]
            if whole[i]:
                state[i] = exit_state
        return out


_compiled: dict[str, CountingTransducer] = {}


def transducer(path: str) -> CountingTransducer:
    """One for each process: what it has compiled serves all its tasks."""
    if path not in _compiled:
        _compiled[path] = CountingTransducer(path)
    return _compiled[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for whole in batches:
            for batch in slices(whole, 1):
                tokens = machine.count(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return tidy(run)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of docs.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no bytes
    and no tokens. Special strings in a text are ordinary text, as in the library.
    Repeated rows count each; an empty table gives an empty one.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(_count(model_path), f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
