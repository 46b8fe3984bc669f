"""Secret scans by grammar inference.

Labelled credentials are laid out as a prefix tree; states whose outgoing frequencies are
statistically compatible (a Hoeffding bound, checked down to their successors) are merged in
one after the other, which gives one probabilistic automaton per format. The stretches of a token that begin
and end beside punctuation are scored by the log-likelihood of their best format against automata of ordinary tokens.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT, keyed, map_texts, rows_of

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_NAMES = (b"passw", b"secret", b"token", b"api")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Shorter tokens are scored only where a labelled credential is shorter.
LEAST = 16


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The three kinds by their patterns, in code points, ends exclusive; matches that fail a check are dropped."""
    out = {k: [] for k in KINDS}
    low = text.encode().lower()
    if any(n in low for n in _NAMES):
        out["assign"] = [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out["access"] = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out["hex"] = [m.span() for m in _HEX.finditer(text)]
    return out


#: Characters of a class are alike for the merging of states; what each is worth is counted once the states are known.
_CLASSES = {"9": string.digits, "f": "abcdef", "z": "ghijklmnopqrstuvwxyz", "F": "ABCDEF", "Z": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS = {c: f"[{k}]" for k, chars in _CLASSES.items() for c in chars}
#: All characters that a candidate may have.
_ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
_PLACE = {c: i for i, c in enumerate(_ALPHABET)}
_SIZE = {f"[{k}]": len(chars) for k, chars in _CLASSES.items()}
#: A token's first characters stand for themselves as long as a tenth of the examples begins with them, but no further than this.
FIXED = 12


class Automaton:
    """A deterministic probabilistic automaton inferred by state merging.

    States of one depth are compared first, so that a format of fixed length becomes a chain whose every state all examples
    pass; then, with that evidence, states of different depths, so that cycles stay only where they repeat. ``table`` has for each state what
    a character gains (log2) and where it leads; one that a state never saw costs ``floor`` and leaves the state.
    """

    def __init__(self, samples: Iterable[str], alpha: float = 0.05, floor: float = 2.0**-12, fixed: int = FIXED):
        samples = list(samples)
        self.floor, self._spread = math.log2(floor), math.sqrt(0.5 * math.log(2 / alpha))
        words = _words(samples, fixed)
        self._step: list[dict[str, int]] = [{}]
        self._count: list[dict[str, int]] = [{}]
        self._end, self._into = [0], [0]
        depths = [[0]]
        for word in words:
            at = 0
            for i, s in enumerate(word):
                if s not in self._step[at]:
                    self._step[at][s] = len(self._step)
                    for column, new in ((self._step, {}), (self._count, {}), (self._end, 0), (self._into, len(self._into))):
                        column.append(new)
                    if i + 1 == len(depths):
                        depths.append([])
                    depths[i + 1].append(len(self._step) - 1)
                self._count[at][s] = self._count[at].get(s, 0) + 1
                at = self._step[at][s]
            self._end[at] += 1
        for nodes in depths:
            kept: list[int] = []
            for q in sorted({self._now(q) for q in nodes}, key=lambda q: (-self._visits(q), q)):
                if self._now(q) == q and not self._merged(kept, q):
                    kept.append(q)
        red, blue = [0], self._next([0])
        while blue:
            if not self._merged(red, blue[0]):
                red.append(blue[0])
            red = list(dict.fromkeys(self._now(q) for q in red))
            blue = self._next(red)
        self.red = red
        self._learn(samples, words)

    def _now(self, q: int) -> int:
        """The state that q has been merged into."""
        while self._into[q] != q:
            self._into[q] = self._into[self._into[q]]
            q = self._into[q]
        return q

    def _next(self, red: list[int]) -> list[int]:
        known = set(red)
        return sorted({self._now(q) for r in red for q in self._step[r].values()} - known)

    def _visits(self, q: int) -> int:
        return self._end[q] + sum(self._count[q].values())

    def _merged(self, kept: list[int], q: int) -> bool:
        for r in kept:
            if self._compatible(r, q):
                self._fold(r, q)
                return True
        return False

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = (self._now(q) for q in todo.pop())
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self._visits(a), self._visits(b)
            if not n or not m or (most := self._spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))) >= 1:
                continue  # no difference can be told from so few examples, and fewer pass the states behind
            if abs(self._end[a] / n - self._end[b] / m) > most:
                return False
            for s in self._count[a].keys() | self._count[b].keys():
                if abs(self._count[a].get(s, 0) / n - self._count[b].get(s, 0) / m) > most:
                    return False
                if s in self._step[a] and s in self._step[b]:
                    todo.append((self._step[a][s], self._step[b][s]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = (self._now(q) for q in todo.pop())
            if a == b:
                continue
            self._into[b] = a
            self._end[a] += self._end[b]
            for s, c in self._count[b].items():
                self._count[a][s] = self._count[a].get(s, 0) + c
                if s in self._step[a]:
                    todo.append((self._step[a][s], self._step[b][s]))
                else:
                    self._step[a][s] = self._step[b][s]

    def _learn(self, samples: list[str], words: list[list[str]]) -> None:
        """Count characters along the merged states, and keep plain tables only."""
        place = {q: i for i, q in enumerate(self.red)}
        steps = [{s: place[self._now(q)] for s, q in self._step[r].items()} for r in self.red]
        passed = [Counter() for _ in steps]
        for token, word in zip(samples, words, strict=True):
            at = 0
            for c, s in zip(token, word, strict=True):
                passed[at][s, c] += 1
                at = steps[at][s]
        self.table, self.last = [], []
        for i, r in enumerate(self.red):
            n, row = self._visits(r) + 1, {}
            for s, to in sorted(steps[i].items(), key=lambda x: len(x[0]), reverse=True):  # what stands for itself comes last and wins
                size, total = _SIZE.get(s, 1), self._count[r][s]
                for c in _CLASSES[s[1]] if s in _SIZE else s:
                    row[c] = (math.log2(total / n * (passed[i][s, c] + 1) / (total + size)) if size > 1 else math.log2(total / n), to)
            self.table.append(row)
            self.last.append(math.log2((self._end[r] + 0.01) / n))
        del self._step, self._count, self._end, self._into  # the tree is no longer needed; what goes to the executors is small

    def score(self, token: str) -> float:
        """log2 likelihood of a whole token."""
        at, total = 0, 0.0
        for c in token:
            gain, at = self.table[at].get(c, (self.floor, at))
            total += gain
        return total + self.last[at]


def _words(samples: list[str], fixed: int) -> list[list[str]]:
    """Tokens as symbols: the frequent starts as they are, then classes; punctuation always stands for itself."""
    starts = Counter(t[:i] for t in samples for i in range(1, min(len(t), fixed) + 1))
    need = max(8, len(samples) / 10)

    def symbols(t: str) -> list[str]:
        k = 0
        while k < min(len(t), fixed) and starts[t[: k + 1]] >= need:
            k += 1
        return [*t[:k], *(_CLASS.get(c, c) for c in t[k:])]

    return [symbols(t) for t in samples]


_ALNUM = string.ascii_letters + string.digits
# Published credential formats as (name, fixed starts, alphabet, length of the rest).
_FORMATS = (
    ("github", ("ghp_", "gho_", "ghs_", "ghu_"), _ALNUM, 36),
    ("gitlab", ("glpat-",), _ALNUM + "_-", 20),
    ("slack", ("xoxb-", "xoxp-"), string.digits + string.ascii_letters, 40),
    ("google", ("AIza",), _ALNUM + "_-", 35),
    ("stripe", ("sk_live_", "sk_test_", "rk_live_"), _ALNUM, 24),
    ("openai", ("sk-",), _ALNUM, 48),
    ("npm", ("npm_",), _ALNUM, 36),
    ("jwt", ("eyJ",), _ALNUM + "_-", 0),
    ("sendgrid", ("SG.",), _ALNUM + "_-", 0),
    ("huggingface", ("hf_",), string.ascii_letters, 34),
)


#: Ordinary tokens stand under labels that begin so, one automaton a label; they are never taken from the corpus.
ORDINARY = "plain"


def _credential(name: str, starts: tuple[str, ...], abc: str, n: int, i: int, draw: random.Random) -> str:
    pick = lambda abc, n: "".join(draw.choice(abc) for _ in range(n))
    if name == "jwt":
        rest = ".".join(pick(abc, k) for k in (33, draw.randint(40, 120), 43))
    elif name == "sendgrid":
        rest = f"{pick(abc, 22)}.{pick(abc, 43)}"
    elif name == "slack":
        rest = f"{pick(string.digits, 12)}-{pick(string.digits, 12)}-{pick(abc[10:], 24)}"
    else:
        rest = pick(abc, n)
    return starts[i % len(starts)] + rest


def ordinary(draw: random.Random) -> dict[str, list[str]]:
    """One token of each kind that looks like a credential and is none, by label: made from parameters, not from the corpus."""
    pick = lambda abc, n: "".join(draw.choice(abc) for _ in range(n))
    vowel, consonant, hexed, upper, digit = "aeiou", "bcdfghjklmnprstvwz", "0123456789abcdef", string.ascii_uppercase, string.digits

    def word(lo: int, hi: int) -> str:
        n = draw.randint(lo, hi)
        return "".join(draw.choice(vowel if i % 2 else consonant) if draw.random() < 0.75 else draw.choice(string.ascii_lowercase) for i in range(n))

    year, month, day = draw.randint(1970, 2039), draw.randint(1, 12), draw.randint(1, 28)
    camel = "".join(word(3, 9).capitalize() for _ in range(draw.randint(2, 5)))
    uuid = "-".join(pick(hexed, n) for n in (8, 4, 4, 4, 12))
    text = " ".join(word(2, 9) for _ in range(draw.randint(3, 20)))
    number, name = pick(digit, draw.randint(16, 24)), "_".join(word(3, 8) for _ in range(draw.randint(2, 4)))
    return {
        ORDINARY: [
            word(16, 28), word(15, 24).capitalize(), "-".join(word(3, 9) for _ in range(draw.randint(3, 6))), "/".join(word(3, 9) for _ in range(4)), f"{name}.{word(2, 4)}",
            camel, camel[0].lower() + camel[1:] + pick(digit, draw.randint(0, 3)), word(16, 28).upper(), "_".join(word(3, 9) for _ in range(draw.randint(3, 5))).upper(),
            f"{word(3, 8)}-{word(3, 8)}-{year}-{month:02}-{day:02}", f"{word(3, 8)}/{year}/{month:02}/{day:02}/{word(4, 9)}.html",
            f"{name}={word(3, 9)}", f"{word(3, 8).capitalize()}-{word(4, 9).capitalize()}-{word(4, 9)}",
        ],
        f"{ORDINARY}-number": [
            number, f"{name}={number}", f"{word(2, 6)}={pick(digit, draw.randint(8, 20))}", f"{year}-{month:02}-{day:02}/{pick(digit, 6)}", f"{year}{month:02}{day:02}{pick(digit, 8)}",
            f"978-{pick(digit, 1)}-{pick(digit, 2)}-{pick(digit, 6)}-{pick(digit, 1)}", f"{draw.randint(0, 99)}.{pick(digit, draw.randint(14, 22))}", f"{pick(digit, 4)}-{pick(digit, 4)}-{pick(digit, 4)}-{pick(digit, 4)}",
            f"IMG_{year}{month:02}{day:02}_{pick(digit, 6)}.jpg", f"{word(3, 8)}-{draw.randint(0, 20)}.{draw.randint(0, 20)}.{draw.randint(0, 20)}.tar.gz", f"{year}-{month:02}-{day:02}T{pick(digit, 6)}.{pick(digit, 3)}",
        ],
        f"{ORDINARY}-uuid": [uuid, uuid.upper() if draw.random() < 0.3 else uuid],
        f"{ORDINARY}-order": [
            f"{pick(upper, draw.randint(2, 4))}-{year}-{pick(digit, draw.randint(6, 9))}", f"{pick(upper, 2)}{pick(digit, draw.randint(13, 18))}", f"ORD-{year}{month:02}{day:02}-{pick(digit, 6)}", f"INV{pick(digit, draw.randint(13, 16))}",
            f"1Z{pick(digit + upper, 6)}{pick(digit, 10)}",
        ],
        f"{ORDINARY}-serial": ["-".join(pick(digit + upper, n) for _ in range(draw.randint(3, 5))) for n in (4, 5)] + [f"SN-{pick(digit + upper, 4)}-{pick(digit + upper, 4)}-{pick(digit + upper, 4)}"],
        f"{ORDINARY}-base64": [base64.b64encode(text.encode()).decode()],
        f"{ORDINARY}-hashed": [f"{word(3, 9)}.{pick(hexed, draw.choice((8, 10, 20)))}.{draw.choice(('js', 'css', 'chunk.js', 'min.js', 'png'))}", f"{word(4, 9)}-{pick(hexed, draw.choice((7, 8, 12)))}-{word(3, 7)}"],
    }


def labelled(per_format: int = 200, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential): examples drawn from the published formats, and ordinary tokens of many kinds under labels that begin with ``plain``."""
    draw, out = random.Random(seed), []
    for fixed in _FORMATS:
        out += [(fixed[0], _credential(*fixed, i, draw)) for i in range(per_format)]
    for _ in range(per_format):
        out += [(label, t) for label, tokens in ordinary(draw).items() for t in tokens if len(t) >= LEAST]
    return out


#: Under this label stand the values that texts themselves assign to a password, secret, token or key.
ASSIGNED = "assigned"
#: Credentials of any label, taken together: what is like several formats, but none of them.
LIKELY = "credential"


def corpus_examples(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4_000, most: int = 2_000, least: int = LEAST) -> list[tuple[str, str]]:
    """What the corpus itself labels: values of ``least`` characters or more that it assigns to a password, secret, token or key (label ``assigned``).

    A token without such a label is never learned from, whether it is a credential or not, so what is found in a text doesn't turn on how often the
    like stands in others. The fit is bounded by two parameters: about ``sample`` documents, chosen by a hash of the key, and
    of their different values ``most``, those with the least hashes. Null keys are not chosen; no documents, no examples.
    """
    n = documents.count()
    draw = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(1 << 30))
    chosen = keyed(documents.where(draw <= int(min(1.0, sample / max(n, 1)) * (1 << 30))), key, text).select(TEXT)

    def run(batches):
        for batch in batches:
            found = dict.fromkeys(t for (x,) in rows_of(batch, 0) for t in _assigned(x or "", least))
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(found), pa.string())})

    rows = chosen.mapInArrow(run, "token string").distinct()
    return sorted((ASSIGNED, r[0]) for r in rows.orderBy(F.xxhash64("token"), "token").limit(most).collect())


def _assigned(text: str, least: int) -> list[str]:
    return [m[2] for m in _ASSIGN.finditer(text) if len(m[2]) >= least] if base_spans(text)["assign"] else []


def infer(examples: Iterable[tuple[str, str]], most: int = 5_000) -> Machines:
    """One automaton per label and one for all credentials; of a label with more than ``most`` different examples those with the least digests are used, a bound of the fit."""
    groups: dict[str, set[str]] = {}
    for name, token in examples:
        groups.setdefault(name, set()).add(token)
    groups[LIKELY] = {t for n, tokens in groups.items() if not n.startswith(ORDINARY) for t in tokens}
    kinds = {LIKELY: {"alpha": 1e-300, "fixed": 0}}  # merged as far as anything is: what they have in common
    chosen = {n: sorted(t) if len(t) <= most else sorted(sorted(t, key=lambda x: hashlib.sha256(x.encode()).digest())[:most]) for n, t in groups.items() if t}
    return Machines({name: Automaton(tokens, **kinds.get(name, {})) for name, tokens in sorted(chosen.items())})


def least_length(examples: Iterable[tuple[str, str]]) -> int:
    """The length from which tokens are scored: that of the shortest labelled credential, ``LEAST`` at most."""
    return min([LEAST, *(len(token) for name, token in examples if not name.startswith(ORDINARY) and token)])


_CALM = re.compile(r"[^A-Z0-9]+")


def widest_calm(examples: Iterable[tuple[str, str]]) -> int:
    """How many small letters and marks may follow each other in a credential: twice what labelled ones have."""
    return 2 * max((len(m) for name, token in examples if not name.startswith(ORDINARY) for m in _CALM.findall(token)), default=0)


def has_bare(examples: Iterable[tuple[str, str]]) -> bool:
    """Whether some labelled credential has neither a digit nor a capital: then others may have none either."""
    return any(_CALM.fullmatch(token) for name, token in examples if not name.startswith(ORDINARY))


class Tables:
    """Several automata side by side as arrays: for each character what every state gains and where it leads."""

    def __init__(self, machines: dict[str, Automaton]):
        self.names = sorted(machines)
        sizes = [len(machines[n].table) for n in self.names]
        self.roots = np.cumsum([0, *sizes[:-1]])
        self.kind = np.repeat(np.arange(len(sizes)), sizes)
        self.last = np.array([x for n in self.names for x in machines[n].last])
        self.knows = {c: np.array([c in machines[n].table[0] for n in self.names]) for c in _ALPHABET}
        self.gain = np.array([[row.get(c, (machines[n].floor, 0))[0] for n in self.names for row in machines[n].table] for c in _ALPHABET])
        self.to = np.array([[base + row.get(c, (0, q))[1] for n, base in zip(self.names, self.roots, strict=True) for q, row in enumerate(machines[n].table)] for c in _ALPHABET])


class Machines(dict):
    """Automata by label, ordinary kinds and formats, and their tables."""

    def __init__(self, machines: dict[str, Automaton]):
        super().__init__(machines)
        self.plain = Tables({n: m for n, m in machines.items() if n.startswith(ORDINARY)})
        self.formats = Tables({n: m for n, m in machines.items() if not n.startswith(ORDINARY)})


def best_format(token: str, machines: Machines) -> tuple[str, float]:
    """The likeliest format and its log2 likelihood ratio against the likeliest ordinary kind, per character."""
    top, name = max((machines[n].score(token), n) for n in machines.formats.names)
    return name, (top - max(machines[n].score(token) for n in machines.plain.names)) / len(token)


def edges(run: str, begins: bool = True, ends: bool = True) -> list[bool]:
    """Whether a stretch may begin or end at each place of a run: where the run does, if it does, and beside punctuation."""
    mark = [not c.isalnum() for c in run]
    return [begins or mark[0], *(x or y for x, y in zip(mark, mark[1:], strict=False)), ends or mark[-1]]


def ordinary_reading(run: str, plain: Tables, edge: list[bool]) -> list[float]:
    """The log2 likelihood of the best ordinary reading of each start of the run; a new ordinary token may begin at each edge."""
    best, values = [0.0], np.full(len(plain.kind), -np.inf)
    values[plain.roots] = 0.0
    for i, c in enumerate(run):
        if i and edge[i]:
            values[plain.roots] = best[i]  # no state is worth more
        k, moved = _PLACE[c], np.full(len(values), -np.inf)
        np.maximum.at(moved, plain.to[k], values + plain.gain[k])
        values = moved
        best.append(float(values.max()))
    return best


def stretches(run: str, machines: Machines, threshold: float = 1.0, least: int = LEAST, begins: bool = True, ends: bool = True) -> list[tuple[int, int, str]]:
    """Disjoint stretches (start, end, format) of a run, those that are in sum furthest above ``threshold``.

    A stretch has ``least`` characters or more; it begins and ends at ``edges``, and with a mark only if its format
    does. Its worth is the log2 likelihood of its format, less that of the same characters in the best ordinary
    reading of the run, less the threshold for each. Of stretches that meet in the same state of a format's
    automaton only the best goes on, so the work grows with the run's length, however many stretches there are.
    """
    formats, size, edge = machines.formats, len(run), edges(run, begins, ends)
    best = ordinary_reading(run, machines.plain, edge)
    worth, came = [0.0] * (size + 1), [None] * (size + 1)
    values, starts = np.full(len(formats.kind), -np.inf), np.zeros(len(formats.kind), np.int64)
    # Stretches of fewer than ``least`` characters so far: a row for each of the last places, a column for each format.
    young, at = np.full((least, len(formats.roots)), -np.inf), np.zeros((least, len(formats.roots)), np.int64)
    for i, c in enumerate(run):
        k, row = _PLACE[c], i % least
        young[row], at[row] = -np.inf, formats.roots
        if edge[i]:
            may = True if c.isalnum() else formats.knows[c]
            young[row] = np.where(may, worth[i] + best[i], -np.inf)
        young += formats.gain[k][at] - threshold
        at = formats.to[k][at]
        reached, to = values + (formats.gain[k] - threshold), formats.to[k]
        values = np.full(len(reached), -np.inf)
        np.maximum.at(values, to, reached)
        won = reached == values[to]
        moved = np.zeros(len(starts), np.int64)
        moved[to[won]] = starts[won]
        starts = moved
        worth[i + 1] = worth[i]
        if i + 1 < least:
            continue
        ripe = (i + 1) % least
        first = i + 1 - least
        q, value = at[ripe], young[ripe]
        better = value > values[q]
        values[q[better]], starts[q[better]] = value[better], first
        if edge[i + 1]:
            top = int(np.argmax(values + formats.last))
            gain = float(values[top] + formats.last[top]) - best[i + 1]
            if gain > worth[i + 1]:
                worth[i + 1], came[i + 1] = gain, (int(starts[top]), formats.names[formats.kind[top]])
    out, i = [], size
    while i > 0:
        if came[i] is None:
            i -= 1
            continue
        out.append((came[i][0], i, came[i][1]))
        i = came[i][0]
    return out[::-1]


def extended(run: str, found: list[tuple[int, int, str]], machines: Machines, threshold: float, edge: list[bool], best: list[float]) -> list[tuple[int, int, str]]:
    """Stretches with their ends moved on over characters that their automaton knows where they stand, as long as the whole is above the threshold: "-" and "_" are letters of some formats.

    What is like several formats and begins where a stretch ends belongs to it.
    """
    out: list[tuple[int, int, str]] = []
    for (a, b, name), limit in zip(found, [*(x[0] for x in found[1:]), len(run)], strict=True):
        machine, q, value, end = machines[name], 0, 0.0, b
        for j in range(a, limit):
            if j >= b and run[j] not in machine.table[q]:
                break
            gain, q = machine.table[q].get(run[j], (machine.floor, q))
            value += gain
            if j >= b and edge[j + 1] and run[j] not in ".=" and value + machine.last[q] - (best[j + 1] - best[a]) >= threshold * (j + 1 - a):
                end = j + 1
        if out and name == LIKELY and out[-1][1] == a:
            out[-1] = (out[-1][0], end, out[-1][2])
        else:
            out.append((a, end, name))
    return out


def islands(run: str, calm: int, edge: list[bool], bare: bool = False) -> list[tuple[int, int]]:
    """The parts of a run that may hold credentials: its digits and capitals, and ``calm`` characters around them, widened to edges.

    ``bare``: credentials may have neither; then all else too, except what lies between two edges and is longer than ``calm``.
    """
    out: list[list[int]] = []
    short = [False] * len(run)
    if bare:
        places = [i for i, x in enumerate(edge) if x]
        for a, b in zip([0, *places], [*places, len(run)], strict=True):
            if b - a <= calm:
                short[a:b] = [True] * (b - a)
    for i, c in enumerate(run):
        if short[i] or c.isdigit() or c.isupper():
            if out and i - out[-1][1] <= calm:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
    parts: list[list[int]] = []
    for a, b in out:
        a, b = max(0, a - calm), min(len(run), b + calm)
        while a > 0 and not edge[a]:
            a -= 1
        while b < len(run) and not edge[b]:
            b += 1
        if parts and a <= parts[-1][1]:
            parts[-1][1] = b
        else:
            parts.append([a, b])
    return [(a, b) for a, b in parts]


def find(text: str | None, machines: Machines, threshold: float = 1.0, least: int = LEAST, calm: int = 32, bare: bool = False) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, str]]]:
    """Base spans by kind; and all spans (start, end, kind), with the likely credentials of ``least`` characters or more that overlap no base span."""
    text = text or ""
    base = base_spans(text)
    spans = [(a, b, k) for k in KINDS for a, b in base[k]]
    taken: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    k = 0
    for m in _CANDIDATE.finditer(text):
        if m.end() - m.start() < least:
            continue
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        at, i = m.start(), k
        while at < m.end():  # the pieces of the run between base spans
            a, b = taken[i] if i < len(taken) and taken[i][0] < m.end() else (m.end(), m.end())
            if a - at >= least:
                piece, begins, ends = text[at:a], at == m.start() or not text[at - 1].isalnum(), a == m.end() or not text[a].isalnum()
                edge = edges(piece, begins, ends)
                for x, y in islands(piece, calm, edge, bare):
                    if y - x >= least and (found := stretches(piece[x:y], machines, threshold, least, edge[x], edge[y])):
                        near = edges(piece[x:y], edge[x], edge[y])
                        longer = extended(piece[x:y], found, machines, threshold, near, ordinary_reading(piece[x:y], machines.plain, near))
                        spans += [(at + x + u, at + x + v, name) for u, v, name in longer]
            at, i = max(at, b), i + 1
    order = {k: i for i, k in enumerate((*KINDS, *sorted(machines)))}
    return base, sorted(spans, key=lambda s: (s[0], order[s[2]], s[1]))


def find_secrets(documents: DataFrame, key: str = "doc_id", text: str = "text", examples: list[tuple[str, str]] | None = None, threshold: float = 1.0) -> DataFrame:
    """For every row: key, ``base`` and ``spans`` (arrays of kind:start:end in code points).

    ``examples``: (format, credential) pairs to learn from, with ordinary tokens under labels that begin with
    ``plain``; if None, the published formats, kinds of ordinary tokens, and the values that the documents assign (``corpus_examples``, a bounded sample). Null
    text counts as empty; repeated rows each get a row; no row is dropped. ``threshold``: bits per character in favour of a format.
    Tokens and their parts of 16 characters or more are scored, shorter ones from the length of the shortest labelled credential;
    stretches of small letters and marks over twice as long as any labelled credential has are in none, and those without a digit
    or capital count only if some labelled credential has neither.
    The automata are inferred once, by the driver, and sent as tables of some hundred states.
    """
    pairs = [*labelled(), *corpus_examples(documents, key, text)] if examples is None else list(examples)
    least, calm, bare = least_length(pairs), widest_calm(pairs), has_bare(pairs)
    shared = documents.sparkSession.sparkContext.broadcast(infer(pairs))

    def make():
        machines = shared.value

        def each(texts):
            base, spans = [], []
            for x in texts:
                own, all_ = find(x, machines, threshold, least, calm, bare)
                base.append([f"{k}:{a}:{b}" for a, _, k, b in sorted((a, KINDS.index(k), k, b) for k in KINDS for a, b in own[k])])
                spans.append([f"{k}:{a}:{b}" for a, b, k in all_])
            return [base, spans]

        return each

    strings = T.ArrayType(T.StringType())
    return map_texts(keyed(documents, key, text), [("base", strings), ("spans", strings)], make, key)
