"""Text decoded with a wrong character encoding: found and restored by corpus statistics.

1. Adjacent character pairs of all texts are counted (digits as one sign, exact copies of a text once), into a table of fixed
   size. A pair's share of the corpus' mutual information, p(ab) log p(ab)/(p(a)p(b)), says how well established it is. The
   bound below which a pair is improbable comes from the corpus too: WEAK_SHARE of all pairs beyond ASCII lie below it.
2. Each pair that a mapping could change scores the bits by which it falls short of the bound (improbable, +) or exceeds it
   (established, -); maximum-scoring segments isolate the runs. Established text, in whatever script, has none and is done.
3. Inside the runs, widened to whole stretches of signs beyond ASCII and nowhere else, inverse mappings are tested: text of a
   single-byte code page read as UTF-8 bytes, as often as it can be, also after lower-casing or HTML escaping; one single-byte
   code page read as another; Japanese double-byte codes; UTF-16 byte order; UTF-7. A mapping is taken if the pairs of the
   restored run are more probable in the corpus by a number of bits. Signs that only a lossy decoding leaves (replacement
   characters, question marks amid text) mark a run too, if filling them in makes it more probable.
4. The signs that a mapping took away count as improbable in that text, its runs are isolated anew and examined again, until no
   more such signs appear: what damage there is besides, made of pairs that the corpus has often, is restored with it.
5. A short sequence between quotation marks whose repaired form is also quoted, or that is one sign, is talk about the
   damage and stays.

Pure ASCII texts without "?", "+", "&" or control characters are unchanged by every mapping and skip all steps.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _slices

#: Size of the pair table (a power of two): its memory is fixed, whatever the corpus.
PAIRS = 1 << 20
#: Code points above this share the last slot of the table of single characters.
CHARS = 1 << 17
#: The share of the corpus' pairs beyond ASCII that counts as improbable: those that add least to the mutual information.
WEAK_SHARE = 0.15
#: Bits that a pair scores at most for or against a run; a pair that no mapping changes scores STEADY.
MOST, STEADY = 4.0, -4.0
#: A score that no run can cross.
WALL = -1e9
#: A pair that was never counted has so little information, in bits.
NONE = 1e-12
#: Bits that a restored text must gain: by UTF-8 or multi-byte mappings, between code pages, by filling in lost signs.
GAIN_MULTI, GAIN_SINGLE, GAIN_LOST = 5.0, 10.0, 10.0
#: Bits from which a run counts for a map between code pages.
LEAST_PAGE = 2.0
#: Bits that filling in a single question mark must gain to count.
GAIN_MARK = 9.0

#: Results of so many different runs of at most so many characters are kept.
KEEP, KEEP_CHARS = 50_000, 80
#: A lost sign is filled in by characters beyond ASCII with at least this share of the corpus.
FILL_SHARE = 1e-6
#: A character with a smaller share of the corpus (as log2) is not believed to be what UTF-7 stands for.
RARE_BITS = -19.0

# Single-byte code pages that text is written in or misread as.
PAGES = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman", "koi8-r", "cp866", "iso8859-5", "iso8859-2", "iso8859-15", "cp1254", "mac-cyrillic", "cp852", "cp1253")
# Double-byte codes of Japanese.
DOUBLE = ("cp932", "euc_jp")
# Quotation marks that may stand before and after a quoted sequence.
OPENING, CLOSING = "\"'“”„«‘’‹»`", "\"'“”»’‘›«`"


@lru_cache
def page_chars(name: str) -> list[str]:
    """The 256 characters of a code page; bytes that it leaves undefined stand for themselves, as web decoders do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache
def page_bytes(name: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(page_chars(name))}


def code_points(text: str) -> np.ndarray:
    """The text's code points with every ASCII digit as 0 and a tab as a blank."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    a[a - 48 < 10] = 48
    a[a == 9] = 32
    return a


def pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)


@dataclass
class PairModel:
    """bits: log2 of each slot's share of all pairs; weight: its score in the search for runs; single: log2 of each character's
    share; frequent: common characters beyond ASCII, which lost signs may have been."""

    bits: np.ndarray
    weight: np.ndarray
    single: np.ndarray
    frequent: list[str]
    bound: float

    @classmethod
    def of_counts(cls, pairs: np.ndarray, chars: np.ndarray, codes: np.ndarray) -> PairModel:
        """pairs, codes: how often a slot was met, and the largest pair in it; chars: how often a character was."""
        n, m = max(1, int(pairs.sum())), max(1, int(chars.sum()))
        bits, single = np.log2((pairs + 0.5) / n), np.log2((chars + 0.5) / m)
        a, b = np.minimum(codes >> 21, CHARS - 1), np.minimum(codes & 0x1FFFFF, CHARS - 1)
        information = np.where(pairs > 0, np.exp2(bits) * (bits - single[a] - single[b]), 0.0)
        beyond = np.flatnonzero((pairs > 0) & ((codes >> 21 > 126) | (codes & 0x1FFFFF > 126)))
        order = beyond[np.argsort(information[beyond], kind="stable")]
        upto = np.cumsum(pairs[order])
        bound = max(NONE, float(information[order[np.searchsorted(upto, WEAK_SHARE * upto[-1])]])) if len(order) else NONE
        weight = np.clip(np.log2(bound) - np.log2(np.maximum(information, NONE)), -MOST, MOST)
        weight[pairs == 0] = MOST
        at = np.flatnonzero(chars[128:] > FILL_SHARE * m) + 128
        common = [chr(c) for c in at[np.argsort(-chars[at], kind="stable")] if 0xA0 < c < CHARS - 1 and c != 0xFFFD and not 0xD800 <= c < 0xE000]
        return cls(bits.astype(np.float32), weight.astype(np.float32), single.astype(np.float32), common, bound)

    def score(self, cps: np.ndarray) -> float:
        return float(self.bits[pair_slots(cps[:-1], cps[1:])].sum()) if len(cps) > 1 else 0.0

    def text_score(self, text: str) -> float:
        return self.score(code_points(text))

    def char_bits(self, c: str) -> float:
        return float(self.single[min(ord(c), CHARS - 1)])


def tally(texts: list[str], pairs: np.ndarray, chars: np.ndarray, codes: np.ndarray) -> None:
    """Add the texts' pairs and characters to the counts."""
    cps = code_points("\n".join(["", *texts, ""]))
    slots = pair_slots(cps[:-1], cps[1:])
    pairs += np.bincount(slots, minlength=PAIRS)
    chars += np.bincount(np.minimum(cps, np.uint64(CHARS - 1)).astype(np.int64), minlength=CHARS)
    both = ((cps[:-1] << np.uint64(21)) | cps[1:]).astype(np.int64)
    more = np.flatnonzero(codes[slots] < both)  # few after the first texts
    np.maximum.at(codes, slots[more], both[more])


def single_copies(documents: DataFrame, text: str = "text", max_broadcast: int = 1_000_000) -> DataFrame:
    """(text): each different text that is not null or empty once. Only 128-bit hashes are shuffled to find the repeated texts,
    combined before; of these, one copy for each task that met it."""
    from ..session import broadcast_if_small, settle

    keys = [F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")]
    rows = documents.select(F.col(f"`{text}`").alias("text")).where("text <> ''").select("text", *keys)
    again = settle(rows.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "encoding-copies")
    again = broadcast_if_small(again, max_broadcast)
    copies = rows.join(again, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first("text").alias("text"))
    return rows.join(again, ["_k1", "_k2"], "left_anti").select("text").unionByName(copies.select("text"))


def count_pairs(documents: DataFrame, text: str = "text") -> PairModel:
    """The model of all texts. Each task counts into tables of fixed size and sends the slots that it met. Exact copies count
    once, wherever they lie, so that a damaged text that fills a third of the corpus does not become its norm."""
    arrow = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), ("n", pa.int64()), ("code", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars, codes = np.zeros(PAIRS, np.int64), np.zeros(CHARS, np.int64), np.zeros(PAIRS, np.int64)
        for whole in batches:
            for batch in _slices(whole.select([0, 0])):
                tally(batch.column(0).to_pylist(), pairs, chars, codes)
        for kind, table in ((0, pairs), (1, chars)):
            at = np.flatnonzero(table)
            code = codes[at] if kind == 0 else np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(table[at]), pa.array(code)], schema=arrow)

    rows = single_copies(documents, text).mapInArrow(run, "kind int, slot int, n bigint, code bigint")
    counted = rows.groupBy("kind", "slot").agg(F.sum("n").alias("n"), F.max("code").alias("code"))
    pairs, chars, codes = np.zeros(PAIRS, np.int64), np.zeros(CHARS, np.int64), np.zeros(PAIRS, np.int64)
    for b in counted.toArrow().to_batches():  # at most PAIRS + CHARS rows
        kind, slot, n, code = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        pairs[slot[kind == 0]], codes[slot[kind == 0]], chars[slot[kind == 1]] = n[kind == 0], code[kind == 0], n[kind == 1]
    return PairModel.of_counts(pairs, chars, codes)


def segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring subsequences [i, j) with a positive sum, by the linear algorithm of Ruzzo and Tompa; scores of one sign
    in a row are taken together first. Where the sum of all scores so far falls to a new low, nothing before can grow any more."""
    if not len(scores):
        return []
    up = scores > 0
    cuts = np.flatnonzero(up[1:] != up[:-1]) + 1
    starts = np.concatenate(([0], cuts))
    sums = np.add.reduceat(scores.astype(np.float64), starts)
    ends = np.concatenate((cuts, [len(scores)]))
    done: list[tuple[int, int]] = []
    open_: list[tuple[float, float, int, int]] = []  # (sum before, sum after, start, end)
    total = low = 0.0
    for s, i, j in zip(sums.tolist(), starts.tolist(), ends.tolist()):
        if s <= 0:
            total += s
            continue
        if total <= low:
            low = total
            done += [(at, to) for _, _, at, to in open_]
            open_ = []
        left, right, at, to = total, total + s, i, j
        total = right
        while True:
            k = len(open_) - 1
            while k >= 0 and open_[k][0] >= left:
                k -= 1
            if k < 0 or open_[k][1] >= right:
                open_.append((left, right, at, to))
                break
            left, at = open_[k][0], open_[k][2]
            del open_[k:]
    return done + [(at, to) for _, _, at, to in open_]


class _Utf8Page:
    """UTF-8 sequences as a code page shows them, found by one pattern; ``folded`` also takes lower-case forms. A sequence is
    left alone if it stands for a character that the corpus never has and that is no sign of further damage."""

    def __init__(self, name: str, folded: bool, seen: Callable[[str], bool]):
        self.seen = seen
        chars = page_chars(name)
        self.byte: dict[str, list[int]] = {}
        for b in range(0x80, 0x100):
            for c in {chars[b], chars[b].lower()} if folded else {chars[b]}:
                if len(c) == 1 and ord(c) > 0x7F:
                    self.byte.setdefault(c, []).append(b)

        def of(lo: int, hi: int) -> str:
            return "[" + "".join(re.escape(c) for c, bs in self.byte.items() if any(lo <= b <= hi for b in bs)) + "]"

        tail = of(0x80, 0xBF)
        self.pattern = re.compile(f"{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}}")

        self.known: dict[str, str] = {}  # at most one entry for each way to write a code point

    def _restore(self, m: re.Match) -> str:
        s = m[0]
        if s not in self.known:
            self.known[s] = self._decoded(s)
        return self.known[s]

    def _decoded(self, s: str) -> str:
        lead = {2: (0xC2, 0xDF), 3: (0xE0, 0xEF), 4: (0xF0, 0xF4)}[len(s)]
        raw = bytes(next(b for b in self.byte[c] if lo <= b <= hi) for c, (lo, hi) in zip(s, [lead] + [(0x80, 0xBF)] * 3))
        try:
            out = raw.decode("utf-8")
        except UnicodeDecodeError:
            return s
        if not self.seen(out):
            return s
        return out

    def __call__(self, s: str) -> str:
        return self.pattern.sub(self._restore, s)


class _Pages:
    """All maps between two code pages as one matrix over the characters that any of them has."""

    def __init__(self) -> None:
        tables = {n: page_chars(n) for n in PAGES}
        universe = sorted({ord(c) for t in tables.values() for c in t[128:] if ord(c) > 0x7F})
        self.slot = np.full(1 << 16, -1, np.int32)
        self.slot[universe] = np.arange(len(universe))
        rows, self.names, seen = [], [], set()
        for shown, t in tables.items():
            for meant, u in tables.items():
                row = np.array(universe, np.uint64)
                for b in range(0x80, 0x100):
                    if ord(t[b]) > 0x7F:
                        row[self.slot[ord(t[b])]] = ord(u[b])
                if shown != meant and row.tobytes() not in seen:
                    seen.add(row.tobytes())
                    rows.append(row)
                    self.names.append(f"{meant} as {shown}")
        self.rows = np.array(rows)
        self.universe = np.array(universe, np.uint64)
        self.tables: dict[int, dict[int, int]] = {}

    def apply(self, cps: np.ndarray) -> np.ndarray:
        """(maps, characters): the code points under every map."""
        slot = np.where(cps < 1 << 16, self.slot[np.minimum(cps, np.uint64(0xFFFF)).astype(np.int64)], -1)
        return np.where(slot >= 0, self.rows[:, np.maximum(slot, 0)], cps)

    def table(self, k: int) -> dict[int, int]:
        if k not in self.tables:
            self.tables[k] = {int(a): int(b) for a, b in zip(self.universe, self.rows[k]) if a != b}
        return self.tables[k]


def _double_bytes(s: str, name: str) -> bytes | None:
    """The text in a double-byte code, with a byte that is never valid for each replacement character; None if it has others that
    the code lacks."""
    out = bytearray()
    for c in s:
        if c == "�":
            out.append(0xFF)
        elif 0x80 <= ord(c) < 0xA0:
            out.append(ord(c))
        else:
            try:
                out += c.encode(name)
            except UnicodeEncodeError:
                return None
    return bytes(out)


_DIGITS = str.maketrans("123456789\t", "000000000 ")
_TWO = re.compile(r"[^\x00-\x7f]{2}")
_UTF7 = re.compile(r"\+[A-Za-z0-9/+]{3,}-?")
_LOST = re.compile("\\?+[^\\x00-\\x7f\ufffd]?|\ufffd+")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,8}|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});")
_ODD = re.compile(r"[^\x20-\x3e\x40-\x7e\t\n\r]|\+[A-Za-z0-9/+]{3,}|&[A-Za-z#]")


def _changed(text: str, i: int, j: int, new: str) -> str:
    """The signs of [i, j) that a map changes, with their neighbours."""
    return "".join(text[max(0, k - 1) : k + 2] for k, (a, b) in enumerate(zip(text[i:j], new), i) if a != b)


def _other_script(old: str, new: str) -> bool:
    """Whether a map between code pages brings in letters beyond Latin; among Latin words that may be an accident."""
    return any(a != b and b.isalpha() and ord(b) > 0x24F for a, b in zip(old, new))


@dataclass
class Finding:
    kind: str = ""
    gain: float = 0.0
    text: str | None = None
    edits: list[tuple[int, int, str]] = field(default_factory=list)


def _sign(entity: str) -> str:
    """The one sign beyond ASCII that an HTML entity stands for; others stay."""
    c = html.unescape(entity)
    return c if len(c) == 1 and ord(c) > 0x7F else entity


def _unescape(text: str) -> str:
    return _ENTITY.sub(lambda m: _sign(m[0]), text)


def _kept(f):
    """A method that keeps its latest results for short arguments: the same words stand in many texts."""

    def call(self, around, *more):
        if len(around) > KEEP_CHARS:
            return f(self, around, *more)
        kept = self.kept.setdefault(f.__name__, {})
        key = (around, *more)
        if key not in kept:
            if len(kept) >= KEEP:
                kept.clear()
            kept[key] = f(self, around, *more)
        return kept[key]

    return call


class Repairer:
    """Finds and restores damage in single texts, given the corpus model."""

    def __init__(self, model: PairModel):
        self.model = model
        self.never = float(model.single.min()) + 0.5
        shown = frozenset(c for n in PAGES for c in page_chars(n)[128:])  # what a text still damaged once more consists of
        seen = lambda c: model.char_bits(c) > self.never or c in shown
        self.exact = {n: _Utf8Page(n, False, seen) for n in PAGES}
        self.folded = {n: _Utf8Page(n, True, seen) for n in PAGES}
        self.pages = _Pages()
        self.common = np.array([ord(c) for c in model.frequent], np.uint64)
        self.kept: dict[str, dict] = {}
        self._between: np.ndarray | None = None

    @property
    def between(self) -> np.ndarray:
        if self._between is None:
            self._between = self.model.bits[pair_slots(self.common[:, None], self.common[None, :])]
        return self._between

    def weights(self, text: str, cps: np.ndarray, signs: set[str] = frozenset()) -> np.ndarray:
        """Each pair's score for a run. signs: characters that this text is known to have from a wrong decoding, as
        is the replacement character always; "+" stands for UTF-7. A UTF-7 sequence, which stands for few signs, scores in all of its pairs what its least established one does."""
        odd = (cps > 126) | (cps < 32) & (cps != 10) & (cps != 13) | (cps == 63)
        coded = [m.span() for m in _UTF7.finditer(text)] if "+" in text else []
        for i, j in coded:
            odd[i:j] = True
        at = np.flatnonzero(odd[:-1] | odd[1:])
        out = np.full(len(cps) - 1, STEADY, np.float32)
        out[at] = self.model.weight[pair_slots(cps[at], cps[at + 1])]
        for i, j in coded:
            out[i:j] = MOST if "+" in signs else out[max(0, i - 1) : j].max()
        for c in {"\ufffd", *signs} - {"+"}:
            if c in text:
                known = np.flatnonzero(cps == ord(c))
                out[known[known > 0] - 1] = MOST
                out[known[known < len(out)]] = MOST
        return out

    @staticmethod
    def runs(weights: np.ndarray, cps: np.ndarray) -> list[tuple[int, int]]:
        """[i, j) character ranges of the improbable runs, each widened to whole words: what lies between blanks."""
        found = segments(weights)
        if not found:
            return []
        i, j = np.array(found).T
        blank = np.concatenate(([-1], np.flatnonzero((cps == 32) | (cps == 10) | (cps == 13)), [len(cps)]))
        first, last = np.searchsorted(blank, i, "right"), np.searchsorted(blank, j)  # j: the last character of the run
        i = np.where(blank[first - 1] == i, i, blank[first - 1] + 1)
        j = np.where(blank[np.minimum(last, len(blank) - 1)] == j, j + 1, blank[np.minimum(last, len(blank) - 1)])
        out: list[tuple[int, int]] = []
        for a, b in zip(i.tolist(), j.tolist()):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def _gain(self, left: str, old: str, new: str, right: str) -> float:
        return self.model.text_score(left + new + right) - self.model.text_score(left + old + right)

    def _likelier(self, old: str, new: str, margin: float = 1.0) -> bool:
        """Whether the characters that a mapping brings in are as common in the corpus as those that it takes away, on the
        average. A shorter text has fewer pairs and so gains bits with whatever characters; this does not hold for these."""
        a, b = Counter(old), Counter(new)
        gone, come = a - b, b - a
        if not gone or not come:
            return bool(gone)
        mean = lambda c: sum(self.model.char_bits(x) * n for x, n in c.items()) / c.total()
        return mean(come) >= max(mean(gone) - margin, self.never + 2.0)

    def _utf8(self, s: str, left: str, right: str, folded: bool) -> tuple[float, str, str]:
        """The best chain of UTF-8 readings: (gain, text, name)."""
        best, level, seen = (0.0, s, ""), [(s, "")], {s}
        if not _TWO.search(s):  # every byte of a sequence is a sign beyond ASCII on every page
            return best
        while level:  # each reading is shorter than what it was read from
            level_next = []
            for t, how in level:
                for name, page in (self.folded if folded else self.exact).items():
                    u = page(t)
                    if u != t and u not in seen:
                        seen.add(u)
                        level_next.append((u, f"utf-8 as {name}" + (f", {how}" if how else "")))
                        gain = self._gain(left, s, u, right)
                        if gain > best[0] and self._likelier(s, u, 4.0) and self._likelier(t, u, 4.0):
                            best = (gain, *level_next[-1])
            level = [x for x in level_next if _TWO.search(x[0])]
        return best

    def _double(self, s: str, left: str, right: str) -> tuple[float, str, str]:
        best = (0.0, s, "")
        tries = []
        for page in ("cp1252", "latin-1", "mac-roman", "cp437", "cp1251"):
            table = page_bytes(page)
            if all(c in table for c in set(s)):
                raw = bytes(table[c] for c in s)
                tries += [(raw, meant, page) for meant in DOUBLE]
        for shown in DOUBLE:
            raw = _double_bytes(s, shown)
            if raw is not None:
                tries += [(raw, meant, shown) for meant in ("utf-8", *DOUBLE) if meant != shown]
        for raw, meant, shown in tries:
            t = raw.decode(meant, "replace")
            if t != s and t.count("�") * 4 <= (len(t) if shown in DOUBLE else 0):
                gain = self._gain(left, s, t, right)
                if gain > best[0] and self._likelier(s, t):
                    best = (gain, t, f"{meant} as {shown}")
        return best

    def _wide(self, s: str, left: str, right: str) -> tuple[float, str, str]:
        best = (0.0, s, "")
        tries = []
        if "\x00" in s:
            raw = s.encode("latin-1", "ignore")
            tries += [(raw[k:], f"utf-16-{e}", "latin-1") for e in ("le", "be") for k in (0, 1)]
        if any(ord(c) > 0x7F and not ord(c) & 0xFF for c in s):
            tries.append((s.encode("utf-16-le", "surrogatepass"), "utf-16-be", "utf-16-le"))
        for raw, meant, shown in tries:
            t = raw.decode(meant, "ignore")
            gain = self._gain(left, s, t, right)
            if gain > best[0]:
                best = (gain, t, f"{meant} as {shown}")
        return best

    def _quoted(self, text: str, i: int, j: int, old: str, new: str) -> bool:
        """Whether the changed part of [i, j) is a quoted sequence that is talked about."""
        k = 0
        while k < min(len(old), len(new)) and old[k] == new[k]:
            k += 1
        e = 0
        while e < min(len(old), len(new)) - k and old[-1 - e] == new[-1 - e]:
            e += 1
        a, b, fixed = i + k, j - e, new[k : len(new) - e]
        # the change may share its first or last sign with what it came from
        for a2, b2, fixed2 in ((a, b, fixed), (a - 1, b, text[a - 1 : a] + fixed), (a, b + 1, fixed + text[b : b + 1])):
            if 0 < a2 and b2 < len(text) and text[a2 - 1] in OPENING and text[b2] in CLOSING:
                again = re.search(f"[{re.escape(OPENING)}]{re.escape(fixed2)}[{re.escape(CLOSING)}]", text)
                return len(fixed2) <= 2 or bool(again)
        return False

    def check(self, text: str | None) -> Finding | None:
        """What is wrong with the text and how it reads restored; None if nothing is. Null and empty texts are sound."""
        return self.check_all([text])[0]

    def check_all(self, texts: list[str | None]) -> list[Finding | None]:
        """check() of each text; the runs of all of them are isolated in one go."""
        out: list[Finding | None] = [None] * len(texts)
        at = [k for k, t in enumerate(texts) if t and (not t.isascii() or "?" in t or _ODD.search(t))]
        if not at:
            return out
        bare = [_unescape(texts[k]) if "&" in texts[k] else texts[k] for k in at]
        joined = "\n" + "\n\n".join(bare) + "\n"
        cps = code_points(joined)
        ends = np.cumsum([len(t) + 2 for t in bare])
        w = self.weights(joined, cps)
        w[ends[:-1] - 1] = WALL
        by_text: dict[int, list[tuple[int, int]]] = {}
        for i, j in self.runs(w, cps):
            by_text.setdefault(int(np.searchsorted(ends, i, "right")), []).append((i, j))
        seen: dict[str, Finding | None] = {}
        for g, runs in by_text.items():
            start = int(ends[g - 1]) if g else 0
            text = texts[at[g]]
            if text not in seen:
                got = self._check(bare[g], cps[start : ends[g]], [(i - start, j - start) for i, j in runs])
                seen[text] = self._escaped(text, got) if got and bare[g] is not text else got
            out[at[g]] = seen[text]
        return out

    def _check(self, text: str, cps: np.ndarray, runs: list[tuple[int, int]]) -> Finding | None:
        padded, signs = f"\n{text}\n", set()
        while True:
            runs = [(a, b) for i, j in runs if (a := max(i, 1)) < (b := min(j, len(cps) - 1))]  # without the line ends
            got = self._examine(padded, cps, runs)
            fresh = {c for i, j, new in got.edits for c in Counter(padded[i:j]) - Counter(new) if ord(c) > 0x7F or c == "+"} - signs
            if not fresh:
                break
            signs |= fresh
            wider = self.runs(self.weights(padded, cps, signs), cps)
            if wider == runs:
                break
            runs = wider  # at most once for each sign
        return got if got.kind else None

    @staticmethod
    def _escaped(text: str, got: Finding) -> Finding:
        """The finding in a text with HTML entities, each of which was one sign when it was made. Entities outside the edits stay."""
        where, at = [0], 0  # where[k]: the position in the padded text of the k-th sign
        for m in _ENTITY.finditer(text):
            where += range(at + 1, m.start() + 1)
            if _sign(m[0]) == m[0]:
                where += range(m.start() + 1, m.end() + 1)
            else:
                where.append(m.start() + 1)
            at = m.end()
        where += range(at + 1, len(text) + 3)
        padded = f"\n{text}\n"
        out, done, escaped = [], 0, False
        for i, j, new in sorted(got.edits):
            out += [padded[done : where[i]], new]
            done = where[j]
            escaped |= done - where[i] > j - i
        restored = "".join([*out, padded[done:]])[1:-1] if got.edits else None
        return Finding(f"{got.kind}, escaped" if escaped else got.kind, got.gain, restored, [(where[i], where[j], new) for i, j, new in got.edits])

    def _examine(self, padded: str, cps: np.ndarray, runs: list[tuple[int, int]]) -> Finding:
        """The mappings and fillings that the runs gain by. padded: the text between two line ends."""
        lower = not any(c.isupper() for c in padded)
        edits: list[tuple[int, int, str]] = []
        kinds: dict[str, float] = {}
        taken = np.zeros(len(cps), bool)

        def accept(i: int, j: int, new: str, how: str, gain: float) -> None:
            edits.append((i, j, new))
            kinds[how] = kinds.get(how, 0.0) + gain
            taken[i:j] = True

        like = padded if "+" in padded else padded.translate(_DIGITS)  # no mapping but UTF-7 changes a digit
        runs = [(i, j) for i, j in runs if j - i + 2 > KEEP_CHARS or not self._sound(like[i - 1 : j + 1], lower)]
        if not runs:
            return Finding()
        single = self._single(padded, runs)
        later = []  # runs in which the map between code pages gains more
        for i, j in runs:
            s = padded[i:j]
            if s.isascii() and "\x00" not in s and "+" not in s:
                continue
            gain, t, how = self._reading(s, padded[i - 1], padded[j], lower)
            if gain >= GAIN_MULTI and not self._quoted(padded, i, j, s, t):
                if gain > single[1].get((i, j), 0.0):
                    accept(i, j, t, how, gain)
                else:
                    later.append((i, j, t, how, gain))
        how, by_run, table = single
        changes = [(i, j, padded[i:j].translate(table), g) for (i, j), g in by_run.items() if not taken[i:j].any()]
        changes = [c for c in changes if not self._quoted(padded, c[0], c[1], padded[c[0] : c[1]], c[2]) and (c[3] >= GAIN_SINGLE or not _other_script(padded[c[0] : c[1]], c[2]))]
        if sum({_changed(padded, *c[:3]): c[3] for c in changes}.values()) >= GAIN_SINGLE:  # the same again is no more evidence
            for c in changes:
                accept(*c[:3], how, c[3])
        for i, j, t, name, gain in later:
            if not taken[i:j].any():
                accept(i, j, t, name, gain)
        lost = sum(self._lost(padded[i - 1 : j + 1]) for i, j in runs if not taken[i:j].any())
        if lost >= GAIN_LOST:
            kinds["lost"] = lost
        out, at = [], 0
        for i, j, new in sorted(edits):
            out += [padded[at:i], new]
            at = j
        text = "".join([*out, padded[at:]])[1:-1] if edits else None
        return Finding(max(kinds, key=kinds.get) if kinds else "", sum(kinds.values()), text, edits)

    @_kept
    def _sound(self, around: str, lower: bool) -> bool:
        """Whether no mapping and no filling gains in a run, given with its neighbours."""
        s = around[1:-1]
        if self._lost(around):
            return False
        if s.isascii() and "\x00" not in s and "+" not in s:
            return True
        gains = self._page_gains(around)
        return (gains is None or float(gains.max()) <= LEAST_PAGE) and self._reading(s, around[0], around[-1], lower)[0] < GAIN_MULTI

    @_kept
    def _reading(self, s: str, left: str, right: str, lower: bool) -> tuple[float, str, str]:
        """The reading of a run by more than one byte for a sign that gains most: (gain, text, name)."""
        tries = [self._utf8(s, left, right, False)]
        if lower:
            tries.append(self._utf8(s, left, right, True))
        if "\x00" in s or any(ord(c) > 0x7F and not ord(c) & 0xFF for c in s):
            tries.append(self._wide(s, left, right))
        if _TWO.search(s):
            tries.append(self._double(s, left, right))
        if "+" in s:
            t = _UTF7.sub(self._utf7, s)
            if t != s:
                tries.append((self._gain(left, s, t, right), t, "utf-7 as ascii"))
        return max(tries, key=lambda x: x[0])

    def _utf7(self, m: re.Match) -> str:
        s = m[0]
        try:
            t = (s if s.endswith("-") else s + "-").encode("ascii").decode("utf-7")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return s
        return t if t and all(ord(c) > 0x7F and self.model.char_bits(c) > RARE_BITS for c in t) else s

    @_kept
    def _page_gains(self, around: str) -> np.ndarray | None:
        """What each map between code pages gains in a run, given with its neighbours; None if there is nothing to map."""
        cps = code_points(around)
        at = np.flatnonzero((cps[:-1] > 127) | (cps[1:] > 127))
        if not len(at):
            return None
        mapped = self.pages.apply(cps)
        gain = self.model.bits[pair_slots(mapped[:, at], mapped[:, at + 1])] - self.model.bits[pair_slots(cps[at], cps[at + 1])]
        return gain.sum(axis=1)

    def _single(self, padded: str, runs: list[tuple[int, int]]) -> tuple[str, dict[tuple[int, int], float], dict[int, int]]:
        """The one map between code pages that restores most, as (name, gain by run where it gains, translation table)."""
        gains = {(i, j): g for i, j in runs if (g := self._page_gains(padded[i - 1 : j + 1])) is not None}
        if not gains:
            return "", {}, {}
        each = np.array(list(gains.values()))
        k = int(np.where(each > LEAST_PAGE, each, 0.0).sum(axis=0).argmax())
        return self.pages.names[k], {r: float(g) for r, g in zip(gains, each[:, k]) if g > LEAST_PAGE}, self.pages.table(k)

    @_kept
    def _lost(self, around: str) -> float:
        """Bits gained by filling in the replacement characters and question marks of a run, given with its neighbours: for a row
        of them, of which the last may be a sign that was misread beside them, the best sequence of frequent characters. Marks
        between quotation marks are talked about."""
        total = 0.0
        if not len(self.common):
            return total
        for m in _LOST.finditer(around):
            a, b = m.span()
            if a < 1 or b >= len(around) or around[a - 1] in OPENING and around[b] in CLOSING:
                continue
            cps = code_points(around[a - 1 : b + 1])
            best = self.model.bits[pair_slots(cps[:1], self.common)]
            for _ in range(b - a - 1):
                best = (best[:, None] + self.between).max(axis=0)
            now = self.model.bits[pair_slots(cps[:-1], cps[1:])]
            if around[a] == "\ufffd":  # never written, however often it was read
                now = np.minimum(now, self.model.bits.min())
            gain = float((best + self.model.bits[pair_slots(self.common, cps[-1:])]).max() - now.sum())
            if gain >= GAIN_MARK:
                total += gain
        return total


def find_damage(documents: DataFrame, model: PairModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, gain, restored) of the damaged texts; restored is null where nothing can be, and keeps what cannot be. Texts are examined whole. Null,
    empty and blank texts are sound; repeated rows are reported as often as they come."""
    ship = documents.sparkSession.sparkContext.broadcast(model)  # of the fixed size PAIRS + CHARS
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(ship.value)
        for whole in batches:
            for batch in _slices(whole):
                got = [(i, f) for i, f in enumerate(repairer.check_all(batch.column(1).to_pylist())) if f]
                at = pa.array([i for i, _ in got], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([f.kind for _, f in got], pa.string()), pa.array([f.gain for _, f in got], pa.float64()), pa.array([f.text for _, f in got], pa.string())], names=[key, "kind", "gain", "restored"])

    return documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"`{key}` {kind}, kind string, gain double, restored string")
