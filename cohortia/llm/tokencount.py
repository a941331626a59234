"""Token counts by a byte-level BPE tokenizer compiled to deterministic transducers.

The split pattern is a finite-state machine over kinds of characters, run as one expression.  The
vocabulary becomes an automaton over bytes with failure links: its state is the longest suffix that
can still grow into a token, and lists the tokens that end here, longest first.  The encoding of a
prefix ends in the longest of them that may follow the last token of what stands before it, so each
transition emits by how many tokens the count so far changes.  States are integers, which pairs of tokens may
stand together is decided once, and paths over frequent pieces are kept as one step.

Long texts are cut into chunks.  A chunk becomes a state map: what stands before its first certain
boundary, the count between its first and last certain boundary, and what stands after.  State maps
compose associatively, so chunks are counted in any tasks and composed as a tree, level by level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, process_cache, whole_text

# Unicode white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
# The endings that the split pattern keeps apart, with the apostrophe before them.
ENDINGS = "s|t|re|ve|m|ll|d"
# The kinds of characters: letters, numbers, others.
KINDS = {"L": r"\p{L}", "N": r"\p{N}", "O": rf"[^{SPACES}\p{{L}}\p{{N}}]"}
CHUNK = 32_768
# What a worker keeps: pairs of tokens judged, and counts of pieces.  Beyond these bounds it starts anew.
MOST_TRANSITIONS = 400_000
MOST_PATHS = 200_000
# Stands for the token before the first one.
START = (1 << 20) - 1
# Positions of a piece that are remembered at once; longer than any token.
SPAN = 4096
# State maps composed by one task at each level of the tree; the last level takes all that is left.
FANOUT = 64


def byte_names() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        names[chr(256 + n)] = b
    return names


class Merges:
    """Byte-pair merges compiled to an automaton over bytes."""

    def __init__(self, vocabulary: list[str], merges: list):
        names = byte_names()
        raw = lambda token: bytes(names[c] for c in token)
        self.tokens = [raw(t) for t in vocabulary if all(c in names for c in t)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(raw(a), raw(b)): n for n, (a, b) in enumerate(pairs)}
        number = {t: n for n, t in enumerate(self.tokens)}
        # By token numbers: the rank of merging a pair, when a token is made (-1: a byte), and of which two.
        self.joint = {number[a] << 20 | number[b]: n for (a, b), n in self.rank.items()}
        self.made, self.halves = [-1] * len(self.tokens), [(-1, -1)] * len(self.tokens)
        for (a, b), n in self.rank.items():
            whole = number[a + b]
            if self.made[whole] < 0:
                self.made[whole], self.halves[whole] = n, (number[a], number[b])
        # Whether a token is its own encoding, and whether two are the encoding of their bytes; decided when first asked.
        self.whole: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.compile()

    def compile(self) -> None:
        """Edges (state * 256 + byte -> state), failure links, depths, tokens at states, and which states hold the tokens that end here."""
        edge: dict[int, int] = {}
        depth, token = [0], [-1]
        for number, data in enumerate(self.tokens):
            state = 0
            for byte in data:
                key = state << 8 | byte
                to = edge.get(key)
                if to is None:
                    to = edge[key] = len(depth)
                    depth.append(depth[state] + 1)
                    token.append(-1)
                state = to
            token[state] = number
        fail, shorter = [0] * len(depth), [0] * len(depth)
        # Shorter suffixes come first.
        for key, to in sorted(edge.items(), key=lambda e: depth[e[1]]):
            state, byte = key >> 8, key & 255
            if state:
                at = fail[state]
                while at and at << 8 | byte not in edge:
                    at = fail[at]
                fail[to] = edge.get(at << 8 | byte, 0)
            shorter[to] = fail[to] if token[fail[to]] >= 0 else shorter[fail[to]]
        longest = [n if token[n] >= 0 else shorter[n] for n in range(len(depth))]
        self.edge, self.depth, self.token, self.fail, self.shorter, self.longest = edge, depth, token, fail, shorter, longest
        self.most = len(edge) + MOST_TRANSITIONS

    def move(self, key: int) -> int:
        """The transition of a state that has no edge of its own: that of its failure link, kept from now on."""
        state, byte = key >> 8, key & 255
        while state and state << 8 | byte not in self.edge:
            state = self.fail[state]
        to = self.edge.get(state << 8 | byte, 0)
        if len(self.edge) < self.most:
            self.edge[key] = to
        return to

    def encode(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None)
            if best is None:
                break
            first, second = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == first and parts[i + 1] == second:
                    out.append(first + second)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def alone(self, token: int) -> bool:
        """Whether the bytes of the token encode to it."""
        if token not in self.whole:
            data = self.tokens[token]
            self.whole[token] = self.encode(data) == [data]
        return self.whole[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of the two together is just these two; after ``START``, whether a token encodes to itself.

        Undoes the later merge of the two, again and again: had the tokens that then meet a merge of lower
        rank than the one undone, it would have come first.  Of equal ranks the left one comes first.
        """
        key, limit = left << 20 | right, len(self.rank)
        found = self.alone(right)
        joint, made, halves = self.joint, self.made, self.halves
        while found and left != START:
            if joint.get(left << 20 | right, limit) < limit:
                found = False
                break
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                break
            if a > b:
                left, limit = halves[left][1], a
            else:
                right, limit = halves[right][0], b + 1
        if len(self.fits) >= MOST_TRANSITIONS:
            self.fits.clear()
        self.fits[key] = found
        return found

    def count(self, piece: bytes) -> int:
        """Tokens of one piece: the sum of what its transitions emit."""
        edge, depth, token, shorter, longest, fits = self.edge, self.depth, self.token, self.shorter, self.longest, self.fits
        state, base, span = 0, 0, len(piece) > SPAN
        # Last token and count after each byte; of a long piece only the end is remembered.
        last, count = [START], [0]
        for byte in piece:
            key = state << 8 | byte
            state = edge.get(key)
            if state is None:
                state = self.move(key)
            at = longest[state]
            while True:
                size = depth[at]
                pair = last[-size] << 20 | token[at]
                fit = fits.get(pair)
                if fit is None:
                    fit = self.follows(pair >> 20, token[at])
                if fit:
                    break
                at = shorter[at]
                if not at:
                    raise ValueError("a byte without a token")
            count.append(count[-size] + 1)
            last.append(token[at])
            if span and len(last) > SPAN:
                # The start is out of every token's reach by now.
                base += count[-SPAN // 2]
                count = [n - count[-SPAN // 2] for n in count[-SPAN // 2 :]]
                last = last[-SPAN // 2 :]
        return base + count[-1]


class Paths(dict):
    """What the transducer counts over frequent pieces: whole paths kept as one step from their second sight on."""

    def __init__(self, walk):
        super().__init__()
        self.walk, self.once = walk, {}

    def __missing__(self, piece):
        n = self.once.pop(piece, None)
        if n is None:
            n = self.walk(piece.encode("utf-8", "surrogatepass"))
            if len(self.once) >= MOST_PATHS // 2:
                self.once.clear()
            if len(piece) < 64:
                self.once[piece] = n
            return n
        if len(self) >= MOST_PATHS:
            self.clear()
        self[piece] = n
        return n


class Transducer:
    """Counts tokens of whole texts and of parts of them; compiled when first used."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        specials = sorted((t["content"] for t in self.spec["added_tokens"]), key=len, reverse=True)
        self.inside = "".join(sorted({c for s in specials for c in s}))
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None

    @cached_property
    def paths(self) -> Paths:
        model = self.spec["model"]
        return Paths(Merges(list(model["vocab"]), model["merges"]).count)

    @cached_property
    def pieces(self) -> regex.Pattern:
        letter, number, other = KINDS.values()
        return regex.compile(f"'(?:{ENDINGS})| ?{letter}+| ?{number}+| ?{other}+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

    @cached_property
    def boundary(self) -> regex.Pattern:
        """Where every text is split, whatever stands around.

        Before white space, and where the kind of character changes, but for an apostrophe before a letter
        and what may be the inside of a special string.
        """
        kinds = KINDS
        inside = f"[{re.escape(self.inside)}]"
        apart = f"(?:(?<!{inside})|(?!{inside}))" if self.inside else ""
        change = [f"(?<={kinds[a]})(?={kinds[b]})" for a, b in ("LN", "LO", "NL", "NO", "ON")]
        change.append(f"(?<={kinds['O']})(?<!')(?={kinds['L']})")
        return regex.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])|{apart}(?:{'|'.join(change)})")

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings: the sum over the pieces of the split pattern."""
        return sum(map(self.paths.__getitem__, self.pieces.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token and ends what stands before it."""
        if self.specials is None:
            return self.plain(text)
        parts = self.specials.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1

    def state_map(self, chunk: str) -> tuple:
        """(head, count, tail) of a chunk with a certain boundary, else (chunk, None, None)."""
        first = self.boundary.search(chunk)
        if first is None:
            return chunk, None, None
        size, last = 32, first.start()
        while size < 2 * len(chunk):
            found = [m.start() for m in self.boundary.finditer(chunk, max(last, len(chunk) - size))]
            if found:
                last = max(last, found[-1])
                break
            size *= 8
        return chunk[: first.start()], self.count(chunk[first.start() : last]), chunk[last:]

    def compose_all(self, maps: Iterable[tuple]) -> tuple:
        """The state map of neighbouring chunks; what hangs together across them is joined once."""
        head, total, open_ = None, 0, []
        for first, count, tail in maps:
            open_.append(first)
            if count is None:
                continue
            if head is None:
                head = "".join(open_)
            else:
                total += self.count("".join(open_))
            total += count
            open_ = [tail]
        text = "".join(open_)
        return (text, None, None) if head is None else (head, total, text)

    def compose(self, left: tuple, right: tuple) -> tuple:
        return self.compose_all((left, right))

    def total(self, whole: tuple) -> int:
        return self.count(whole[0]) + (0 if whole[1] is None else whole[1] + self.count(whole[2]))


def transducer(path: str) -> Transducer:
    return process_cache(f"transducer {path}", lambda: Transducer(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row, special strings as the library's default.

    ``path`` is the tokenizer file, at the same place on every executor.  A missing or empty text has
    no bytes and no tokens; repeated rows and ids are counted each; other columns are ignored, and an
    id may be missing.  Texts above ``chunk`` characters are counted chunk by chunk, equal ones once.
    What has no certain boundary inside, a single run of letters, say, is counted as one.
    """
    given = docs.select(col(id_col).alias("id"), whole_text(text_col).alias("text"))
    id_type = given.schema["id"].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    short = given.where(F.length("text") <= chunk).select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def count_short(batches):
        machine = transducer(path)
        for b in batches:
            n = [machine.count(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    long = given.where(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    # Chunks are dealt out, so that one long text is counted by many tasks; those of copies collapse on the way.
    seq = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / F.lit(chunk)).cast("int")))
    pieces = long.select("key", "text", seq.alias("seq")).select("key", "seq", F.expr(f"substring(text, seq * {chunk} + 1, {chunk})").alias("piece"))
    pieces = pieces.groupBy("key", "seq").agg(F.first("piece").alias("piece"))
    maps_type = "key string, seq int, head string, count long, tail string"

    def map_rows(keys: list, seqs: list, maps: list[tuple]) -> pa.RecordBatch:
        head, count, tail = zip(*maps) if maps else ((), (), ())
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip((keys, seqs, head, count, tail), kinds)], names=["key", "seq", "head", "count", "tail"]
        )

    def map_chunks(batches):
        machine = transducer(path)
        for b in batches:
            yield map_rows(b.column(0).to_pylist(), b.column(1).to_pylist(), [machine.state_map(t) for t in b.column(2).to_pylist()])

    def compose(span: int | None):
        """Compose the maps of each text in chunk order, ``span`` numbers at a time or all."""

        def groups(batches) -> Iterator[tuple]:
            place, held = None, []
            for b in batches:
                for key, seq, *one in zip(*(c.to_pylist() for c in b.columns)):
                    now = key, 0 if span is None else seq // span
                    if now != place:
                        if held:
                            yield place, held
                        place, held = now, []
                    held.append(tuple(one))
            if held:
                yield place, held

        def run(batches):
            machine = transducer(path)
            for (key, seq), maps in groups(batches):
                yield map_rows([key], [seq], [machine.compose_all(maps)])

        return run

    maps = pieces.mapInArrow(map_chunks, maps_type)
    for span in (FANOUT, FANOUT, None):
        keys = ["key"] if span is None else ["key", F.floor(F.col("seq") / span)]
        maps = maps.repartition(*keys).sortWithinPartitions("key", "seq").mapInArrow(compose(span), maps_type)

    def finish(batches):
        machine = transducer(path)
        for b in batches:
            totals = [machine.total(m) for m in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(totals, pa.int64())], names=["key", "n_tokens"])

    totals = maps.mapInArrow(finish, "key string, n_tokens long")
    rows = long.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "key")
    counted = rows.join(totals, "key").select("id", "n_bytes", "n_tokens")
    return short.mapInArrow(count_short, out).unionByName(counted).withColumnRenamed("id", id_col)
