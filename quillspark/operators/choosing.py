"""Within one draft: which sources a sentence may come from, and which one each takes.

Texts are numbers into the draft's distinct texts, and sources their places in order of their ids,
so that the batches here hold a text once."""

from __future__ import annotations

from collections.abc import Callable
from heapq import nsmallest
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

INTS = pa.list_(pa.int32())
#: The texts of a draft's parts and of its sources, as numbers, and where each text is first.
NUMBERED = pa.struct({"parts": INTS, "spoken": INTS, "first": INTS})
#: uses: the option of each sentence. like: the first source of equal text and form, for each source.
#: wanted: the texts that are compared. options: a text, how it is held, whether by nothing but
#: itself in an account, the sets of sources that it may have (of equal ones the first alone) and
#: the first candidates.
MET = pa.struct({"uses": INTS, "like": INTS, "wanted": INTS, "options": pa.list_(pa.struct({"t": pa.int32(), "how": pa.string(), "plain": pa.bool_(), "sets": pa.list_(INTS), "candidates": INTS}))})
#: The set that each sentence takes, and the source of it (-1 if there is no choice).
TAKEN = pa.struct({"pick": INTS, "at": INTS})
#: Words of a sentence that a longer source may hold; candidates of a sentence, and links that it may have.
LEAST_WORDS, MOST = 4, 3
#: Drafts that are made Python lists at once.
SOME = 256


def _lists(a: pa.Array) -> list:
    if isinstance(a, pa.ListArray | pa.LargeListArray):
        offsets, flat = a.offsets.to_numpy(), _lists(a.flatten())
        return [flat[i:j] for i, j in pairwise((offsets - offsets[0]).tolist())]
    return a.to_pylist() if a.null_count or pa.types.is_string(a.type) else a.to_numpy(zero_copy_only=False).tolist()


def _numbered(parts: list[int], spoken: list[int]) -> dict[str, list]:
    """parts and spoken: any numbers that are equal for equal texts."""
    first: dict[int, int] = {}
    for k, c in enumerate([*parts, *spoken]):
        first.setdefault(c, k)
    local = {c: n for n, c in enumerate(first)}
    return {"parts": [local[c] for c in parts], "spoken": [local[c] for c in spoken], "first": list(first.values())}


def _most_shared(words: set[str], index: dict[str, list[int]], n: int) -> list[tuple[int, int]]:
    """The numbers of the MOST keys (of n) that share most of words, and how many: ties by number."""
    if not (meets := [k for w in words for k in index[w]]):
        return []
    shared = np.bincount(meets, minlength=n)
    score = shared * n - np.arange(n)
    top = np.argpartition(score, -MOST)[-MOST:] if n > MOST else np.arange(n)
    return sorted(((int(k), int(shared[k])) for k in top if shared[k]), key=lambda x: (-x[1], x[0]))


def _met(keys: list[str], said: list[int], ords: list[int], spoken: list[int], forms: list[str], asked: list[int], places: list[int | None]) -> dict[str, list]:
    """Options of a draft's sentences (said: their texts, with their ords). Sources (spoken: their
    texts, with forms: what else tells them apart) hold a sentence whose key they have, or else one
    of LEAST_WORDS in theirs; of others those that share most distinct words are candidates. asked:
    ords with the places of sources that are chosen for them (None: unknown), which are linked if
    all are known and MOST at most, and else invalid."""
    first: dict[tuple[int, str], int] = {}
    own: dict[int, list[int]] = {}  # the first places of equal sources
    of: dict[str, list[int]] = {}  # by key
    like: list[int] = []
    for p, x in enumerate(zip(spoken, forms, strict=True)):
        if (q := first.setdefault(x, p)) == p:
            own[p] = [p]
            if key := keys[x[0]]:
                of.setdefault(key, []).append(p)
        elif len(own[q]) < MOST:
            own[q].append(p)
        like.append(q)
    numbered = list(of)
    loose = {key for t in set(said) if (key := keys[t]) and key not in of}
    whole = "\n".join(f" {k} " for k in numbered) if loose else ""
    index: dict[str, list[int]] = {w: [] for key in loose for w in key.split(" ")}
    if index:
        for k, other in enumerate(numbered):
            for w in index.keys() & other.split(" "):
                index[w].append(k)

    def starts(sources: list[int]) -> list[int]:
        return own[sources[0]] if len(sources) == 1 else nsmallest(MOST, (p for q in sources for p in own[q]))

    def held(key: str) -> tuple[str, list[int], list[int]]:
        """How a key is held, its sources and the candidates."""
        if sources := of.get(key):
            return "exact", sources, starts(sources)
        if not key or not numbered:
            return "none", [], []
        words, inner = key.split(" "), f" {key} "
        if len(words) >= LEAST_WORDS and inner in whole:
            inside = sorted(q for k in numbered if inner in f" {k} " for q in of[k])
            return "contained", inside, starts(inside)
        near = [p for _, p in nsmallest(MOST, ((-n, p) for k, n in _most_shared(set(words), index, len(numbered)) for p in starts(of[numbered[k]])))]
        return ("suggested", [like[near[0]]], near) if near else ("none", [], [])

    chosen: dict[int, list[int | None]] = {}
    for o, p in zip(asked, places, strict=True):
        chosen.setdefault(o, []).append(p)
    known: dict[int, tuple[str, list[int], list[int]]] = {}
    numbers: dict[int | tuple[int, int], int] = {}
    options, uses, wanted = [], [], set()

    def option(t: int, link: list[int | None] | None) -> dict[str, object]:
        if t not in known:
            known[t] = held(keys[t])
        how, sources, near = known[t]
        sets = [[q] for q in sources] if how in ("exact", "contained") else [sources]
        if link is not None and (len(link) > MOST or None in link):
            how, sets = "invalid", [[like[near[0]]] if near else []]
        elif link is not None:
            how, sets = "linked", [sorted(link)]
        texts = {spoken[q] for some in sets for q in some}
        if keys[t] and texts != {t}:
            wanted.update((t, *texts))
        return {"t": t, "how": how, "plain": how == "exact" and texts == {t} and not any(forms[q] for q in sources), "sets": sets, "candidates": near}

    for o, t in zip(ords, said, strict=True):
        link = chosen.get(o)
        at = t if link is None else (t, o)
        if (use := numbers.get(at)) is None:
            use = numbers[at] = len(options)
            if link is None and (sources := of.get(keys[t])) and len(sources) == 1 and spoken[q := sources[0]] == t:  # as most are
                options.append({"t": t, "how": "exact", "plain": not forms[q], "sets": [sources], "candidates": own[q]})
            else:
                options.append(option(t, link))
        uses.append(use)
    return {"uses": uses, "like": like, "wanted": sorted(wanted), "options": options}


def _taken(uses: list[int], like: list[int], hows: list[str], sets: list[list[list[int]]], clean: list[list[bool]]) -> dict[str, list]:
    """Which set each sentence takes, in their order: of the sources that hold it the first that no
    earlier sentence has taken with a clean set, or else the first. Links are what they are."""
    own: dict[int, list[int]] = {}
    for p, q in enumerate(like):
        own.setdefault(q, []).append(p)
    upto, used, pick, at = dict.fromkeys(own, 0), set(), [], []
    for u in uses:
        k, p = 0, -1
        if hows[u] in ("exact", "contained"):
            best = None
            for n, (q,) in enumerate(sets[u]):
                some, i = own[q], upto[q]
                while i < len(some) and some[i] in used:
                    i += 1
                upto[q] = i
                if i < len(some) and (best is None or some[i] < best[0]):
                    best = some[i], n
            p, k = best or min((q, n) for n, (q,) in enumerate(sets[u]))
            if clean[u][k]:
                used.add(p)
        elif hows[u] == "linked" and clean[u][0]:
            used.update(sets[u][0])
        pick.append(k)
        at.append(p)
    return {"pick": pick, "at": at}


def by_draft(one: Callable[..., dict[str, list]], kind: pa.DataType, coded: bool = False) -> Callable[..., Column]:
    """A function of columns of lists that gives those of each row to one: where coded, texts as
    numbers that are equal in a batch for equal texts."""

    def run(*columns: pa.Array) -> pa.Array:
        if coded:
            codes = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode().indices
            at = np.cumsum([0, *(len(c.flatten()) for c in columns)])
            columns = tuple(pa.ListArray.from_arrays(pa.array(c.offsets.to_numpy() - c.offsets[0].as_py(), pa.int32()), codes[i:j]) for c, (i, j) in zip(columns, pairwise(at.tolist()), strict=True))
        parts = [pa.array(list(map(one, *[_lists(c.slice(k, SOME)) for c in columns])), type=kind) for k in range(0, len(columns[0]), SOME)]
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return F.arrow_udf(run, from_arrow_type(kind))


numbered, met, taken = by_draft(_numbered, NUMBERED, True), by_draft(_met, MET), by_draft(_taken, TAKEN)
