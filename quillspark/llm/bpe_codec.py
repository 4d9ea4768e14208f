"""BPE encoding and decoding by speculate and verify.

A word is first cut greedily into the longest vocabulary entries. That guess is the
right answer exactly if every pair of neighbours in it would also stay two tokens
when its joined text were encoded alone, so all neighbouring pairs of a batch are
tested at once with numpy, and only words with a failing pair go through exact
merging. The vocabulary file is a parameter (``tokenizers`` JSON of kind BPE with
an end-of-word suffix); no tokenizer is trained.

Nulls are read as empty text; an empty text has no tokens. Texts are processed whole,
whatever their length; repeated rows each get their tokens; an empty table gives no rows;
extra input columns are ignored. The strings of added special
tokens are found in the raw text and become their own ids, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import slices, table, whole_text

NEVER = np.iinfo(np.int64).max
#: What the file's normaliser calls white space.
NOT_WHITE = regex.compile("[\x1c-\x1f]")
WHITE = r"[\x09-\x0D\x20\x85\xA0  -     　]"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others count up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class IntTable:
    """Integers to integers by open addressing, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        self.probes = 1
        at, rest = self._home(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[at[rest]] == -1
            _, first = np.unique(at[rest[free]], return_index=True)
            take = rest[free][first]
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            rest = np.setdiff1d(rest, take, assume_unique=True)
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at, out, rest = self._home(keys), np.full(len(keys), -1, np.int64), None
        for _ in range(self.probes):
            i = slice(None) if rest is None else rest
            found = self.keys[at[i]]
            hit = found == keys[i]
            if rest is None:
                out[hit] = self.values[at[hit]]
                rest = np.flatnonzero(~hit & (found != -1))
            else:
                out[rest[hit]] = self.values[at[rest[hit]]]
                rest = rest[~hit & (found != -1)]
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
        return out


#: Words of more symbols are cut and merged one at a time.
SHORT = 32
STEP = np.uint64(0x100000001B3)
#: Pairs that are remembered: a later one takes the slot of an earlier one.
VERDICT_BITS = 20


class WordBpe:
    """One vocabulary with its merges, and bounded caches of words and pairs."""

    def __init__(self, spec: dict, most_runs: int = 250_000):
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.names = {i: s for s, i in (self.vocab | self.special).items()}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.n = n = max(self.names) + 1
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        made_at = np.full(n, -1, np.int64)
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for k, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[x, y] = k, z
            if made_at[z] < 0:
                made_at[z], left[z], right[z] = k, x, y
        #: Greedy guesses are only provable where merges were learned bottom up, each entry in one way.
        self.provable = len({z for _, z in self.rank.values()}) == len(merges) and all(
            made_at[x] < k and made_at[y] < k for (x, y), (k, _) in self.rank.items()
        )
        self.pair_rank = IntTable(np.array([x * n + y for x, y in self.rank], np.int64), np.array([k for k, _ in self.rank.values()], np.int64))
        self.made = np.array([z for _, z in self.rank.values()], np.int64)
        # The symbols next to an entry's right (left) end while it is being merged, and the rank that ends each.
        self.right_edge, self.right_until = self._edges(right, made_at)
        self.left_edge, self.left_until = self._edges(left, made_at)
        self.bytes_as = byte_symbols()
        as_byte = {c: i for i, c in enumerate(self.bytes_as)}
        spelt = {i: bytes(as_byte[c] for c in s.removesuffix(self.suffix)) for s, i in self.vocab.items()}
        ends = {i for s, i in self.vocab.items() if self.suffix and s.endswith(self.suffix)}
        self.inner = self._hashed({i: s for i, s in spelt.items() if i not in ends})
        self.final = self._hashed({i: s for i, s in spelt.items() if i in ends or not self.suffix})
        self.longest = max(len(s) for i, s in spelt.items() if i not in ends)
        self.alone = np.array([self.vocab.get(c, -1) for c in self.bytes_as], np.int64)
        self.alone_last = np.array([self.vocab.get(c + self.suffix, -1) for c in self.bytes_as], np.int64)
        self.power = STEP ** np.arange(SHORT + 1, dtype=np.uint64)
        self.most_runs = most_runs
        # Two generations of runs: the old one goes when the young one is half of what is allowed.
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        # Verdicts on pairs, each in the one slot that its key hashes to: pair * 2 + verdict.
        self.verdicts = np.full(1 << VERDICT_BITS, -1, np.int64)
        self.exact_words = self.guessed_words = 0
        #: Splits as the file's pre-tokenizer; white space belongs to no part.
        self.parts = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def _hash(spelt: bytes) -> int:
        h = 0
        for b in spelt:
            h = (h * int(STEP) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _hashed(self, entries: dict[int, bytes]) -> IntTable:
        keys = np.array([self._hash(s) for s in entries.values()], np.uint64)
        assert len(np.unique(keys)) == len(keys), "hashes of vocabulary entries collide"
        return IntTable(keys.astype(np.int64), np.array(list(entries), np.int64))

    @staticmethod
    def _edges(child: np.ndarray, made_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge, until = [np.arange(len(child))], [np.full(len(child), NEVER)]
        while (edge[-1] >= 0).any():
            at = edge[-1]
            down = np.where(at >= 0, child[at], -1)
            until.append(np.where(down >= 0, made_at[at], -1))
            edge.append(down)
        return np.stack(edge[:-1]), np.stack(until[:-1])

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the entries a[i], b[i] stay two when their joined text is encoded:
        no merge across the seam comes up while both of its symbols stand there. At
        equal rank the one further left comes first."""
        ok = np.ones(len(a), bool)
        for x_edge, x_until in zip(self.right_edge, self.right_until, strict=True):
            x, x_end = x_edge[a], x_until[a]
            if not (live := ok & (x >= 0)).any():
                break
            for y_edge, y_until in zip(self.left_edge, self.left_until, strict=True):
                i = np.flatnonzero(live & (y_edge[b] >= 0))
                if not len(i):
                    break
                rank = self.pair_rank.get(x[i] * self.n + y_edge[b[i]])
                ok[i[(rank >= 0) & (rank < x_end[i]) & (rank <= y_until[b[i]])]] = False
        return ok

    def _pairs_ok(self, key: np.ndarray) -> np.ndarray:
        """compatible() of unique pair keys. What was found before is looked up, in time that
        doesn't grow with how much that is."""
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - VERDICT_BITS)).astype(np.int64)
        held = self.verdicts[slot]
        ok = (held & 1).astype(bool)
        fresh = np.flatnonzero(held >> 1 != key)
        if len(fresh):
            ok[fresh] = self.compatible(key[fresh] // self.n, key[fresh] % self.n)
            self.verdicts[slot[fresh]] = key[fresh] * 2 + ok[fresh]
        return ok

    def guess(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words (rows of bytes, size of each): entries
        row by row, -1 behind the last, and how many there are. The last entry is one
        that ends a word. A word that can't be cut so has 0."""
        count, width = rows.shape
        prefix = np.zeros((count, width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * STEP + rows[:, j] + np.uint64(1)

        def key(r: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            return (prefix[r, stop] - prefix[r, start] * self.power[stop - start]).astype(np.int64)

        out, used, at = np.full((count, width), -1, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
        todo = np.arange(count)
        while len(todo):
            found = self.final.get(key(todo, at[todo], size[todo]))
            done = found >= 0
            out[todo[done], used[todo[done]]] = found[done]
            used[todo[done]] += 1
            todo = todo[~done]
            open_, length = todo, np.minimum(size[todo] - at[todo] - bool(self.suffix), self.longest)
            failed = []
            while len(open_):
                short = length < 1
                failed.append(open_[short])
                open_, length = open_[~short], length[~short]
                found = self.inner.get(key(open_, at[open_], at[open_] + length))
                hit = found >= 0
                r = open_[hit]
                out[r, used[r]] = found[hit]
                used[r] += 1
                at[r] += length[hit]
                open_, length = open_[~hit], length[~hit] - 1
            if len(none := np.concatenate(failed) if failed else todo[:0]):
                used[none] = 0
                todo = np.setdiff1d(todo, none)
        return out, used

    def merge_rows(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each step every word merges its
        pair of lowest rank, the leftmost of equals."""
        count, width = rows.shape
        ids = np.where(np.arange(width) < size[:, None], self.alone[rows], -1)
        ids[np.arange(count), size - 1] = self.alone_last[rows[np.arange(count), size - 1]]
        size, live = size.copy(), np.arange(count)

        def ranks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            rank = self.pair_rank.get((x * self.n + y).ravel()).reshape(x.shape)
            return np.where((rank < 0) | (x < 0) | (y < 0), NEVER, rank)

        cost = np.full((count, width), NEVER)
        cost[:, :-1] = ranks(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(live):
            part = cost[live]
            at = part.argmin(1)
            least = part[np.arange(len(live)), at]
            live, at, least = live[least < NEVER], at[least < NEVER], least[least < NEVER]
            if not len(live):
                break
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            mine = np.take_along_axis(ids[live], source, 1)
            costs = np.take_along_axis(cost[live], source, 1)
            r = np.arange(len(live))
            mine[r, at] = self.made[least]
            mine[:, -1], costs[:, -1] = -1, NEVER
            size[live] -= 1
            nxt = np.minimum(at + 1, width - 1)
            costs[r, at] = np.where(at + 1 < width, ranks(mine[r, at], mine[r, nxt]), NEVER)
            back = at > 0
            costs[r[back], at[back] - 1] = ranks(mine[r[back], at[back] - 1], mine[r[back], at[back]])
            ids[live], cost[live] = mine, costs
        return ids, size

    def merge(self, spelt: bytes) -> list[int]:
        """Exact merging of one long word. All places of the lowest rank merge in one
        pass, from the left: a new pair's rank is higher, as merges are learned
        bottom up; where they aren't, one place merges at a time."""
        last = len(spelt) - 1
        ids = [int((self.alone_last if i == last else self.alone)[b]) for i, b in enumerate(spelt)]
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            x, y = ids[best[1]], ids[best[1] + 1]
            z, out, i = self.rank[x, y][1], ids[: best[1]], best[1]
            while i < len(ids):
                hit = i + 1 < len(ids) and ids[i] == x and ids[i + 1] == y
                out.append(z if hit else ids[i])
                i += 1 + hit
                if hit and not self.provable:
                    out += ids[i:]
                    break
            ids = out
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (never empty), in the order given."""
        spelt = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        out: list[list[int]] = [[] for _ in words]
        for low, high in ((1, 8), (9, 16), (17, SHORT)):
            if not len(these := np.flatnonzero((lengths >= low) & (lengths <= high))):
                continue
            rows = np.frombuffer(b"".join(spelt[i].ljust(high, b"\0") for i in these), np.uint8).reshape(len(these), high)
            size = lengths[these]
            ids, used = self.guess(rows, size) if self.provable else (np.full(rows.shape, -1, np.int64), np.zeros(len(these), np.int64))
            fits = used > 0
            r, c = np.nonzero((ids[:, 1:] >= 0) & (np.arange(1, high) < used[:, None]))
            if len(r):
                key, back = np.unique(ids[r, c] * self.n + ids[r, c + 1], return_inverse=True)
                fits[r[~self._pairs_ok(key)[back]]] = False
            if not fits.all():
                wrong = np.flatnonzero(~fits)
                ids[wrong], used[wrong] = self.merge_rows(rows[wrong], size[wrong])
            self.guessed_words += int(fits.sum())
            self.exact_words += int((~fits).sum())
            for i, row, n in zip(these.tolist(), ids.tolist(), used.tolist(), strict=True):
                out[i] = row[:n]
        for i in np.flatnonzero(lengths > SHORT).tolist():
            out[i] = self.merge(spelt[i])
            self.exact_words += 1
        return out

    def learn(self, runs: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """The ids, packed, and the decoded text of runs without white space."""
        runs = list(runs)
        parts = [(r,) if r.isascii() and r.isalpha() else self.parts.findall(r) for r in runs]
        words = list({w for p in parts for w in p})
        known = dict(zip(words, self.encode_words(words), strict=True))
        name, out = self.names.__getitem__, {}
        for run, part in zip(runs, parts, strict=True):
            ids = known[part[0]] if len(part) == 1 else [i for w in part for i in known[w]]
            out[run] = struct.pack(f"<{len(ids)}I", *ids), " ".join(map(name, ids))
        return out

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter (no final-sigma rule)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def runs(self, text: str) -> list[str]:
        """Runs without white space, special tokens among them as they stand."""
        if self.at_special is not None and "<|" in text and any(s in text for s in self.special):
            parts = self.at_special.split(text)
        else:
            parts = [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif not NOT_WHITE.search(part):
                out += self.normal(part).split()
            else:  # what Python takes for white space and the file doesn't
                out += filter(None, regex.split(WHITE + "+", self.normal(part)))
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text."""
        split = [self.runs(t) for t in texts]
        wanted = set().union(*split)
        unknown = wanted - self.young.keys()
        if len(self.young) + len(unknown) > self.most_runs // 2:
            self.old, self.young = self.young, {}
            unknown = wanted
        again = unknown & self.old.keys()
        self.young.update((r, self.old[r]) for r in again)
        unknown -= again
        self.young.update((s, (struct.pack("<I", self.special[s]), s)) for s in unknown & self.special.keys())
        self.young.update(self.learn(unknown - self.special.keys()))
        held = [list(map(self.young.__getitem__, runs)) for runs in split]
        return [(b"".join([i for i, _ in h]), " ".join([t for _, t in h])) for h in held]

    def decode(self, ids: Iterable[int]) -> str:
        """Entries joined by single spaces: what a file without a decoder means."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        return WordBpe(json.load(f))


def default_path() -> str:
    """Where the installed public vocabulary is, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, keys: tuple[str, ...] = ("doc_id",), with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """keys, n_tokens, ids_sha256, decoded_sha256, with with_ids also ids (array
    of int), and with with_text decoded. One pass over the rows, without a shuffle."""
    kept = docs.select(*keys, whole_text().alias("text"))
    fields = [kept.schema[k] for k in keys]
    out = kept.select(*keys, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"))
    if with_ids:
        out = out.select("*", F.array(F.lit(0).cast("int")).alias("ids"))
    if with_text:
        out = out.select("*", F.lit("").alias("decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or default_path())
        for batch in slices(batches, "text", 3 << 19):
            got = bpe.encode(batch.column("text").to_pylist())
            columns = [batch.column(f.name) for f in fields] + [
                pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()),
                pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for _, d in got], pa.string()),
            ]
            names = [f.name for f in fields] + ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(i, "<u4").astype("i4") for i, _ in got], pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                columns.append(pa.array([d for _, d in got], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(run, out.schema)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the public word vocabulary."""
    return encode(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_bpe_codec": op10_bpe_codec}
SQL: dict[str, str] = {}
