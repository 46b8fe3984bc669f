"""Scorers as a plug: anything that turns a batch of texts into numbers."""

from __future__ import annotations

import hashlib
import json
import subprocess
import tempfile
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.sinks import written
from .checks import Violation, require
from .governance import schema_errors


class Scorer(Protocol):
    """``name`` identifies the model; ``__call__`` gives one number for each text, in order."""

    name: str

    def __call__(self, texts: list[str]) -> list[float]: ...


class HashScorer:
    """A deterministic surrogate in [0, 1): the first digest bytes of the text."""

    name = "hash"

    def __call__(self, texts: list[str]) -> list[float]:
        return [int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) / 4294967296.0 for t in texts]


class Salted(HashScorer):
    """The surrogate with a name in front of each text: another one for each run."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, texts: list[str]) -> list[float]:
        return super().__call__([self.name + t for t in texts])


class Adapter(Protocol):
    """A scorer that adapts to a target before it scores: first all texts of the target are folded into a state, then texts are scored with it.

    States are bytes. ``fold`` and ``merge`` are called in a fixed order, so they need be neither commutative nor exact;
    ``seed`` tells runs apart.
    """

    name: str
    seed: int

    def start(self) -> bytes: ...

    def fold(self, state: bytes, texts: list[str]) -> bytes: ...

    def merge(self, left: bytes, right: bytes) -> bytes: ...

    def score(self, state: bytes, texts: list[str]) -> list[float]: ...


class Shifted(HashScorer):
    """A surrogate adapter: the seeded surrogate less its mean over the target. Its state is a count and a sum of numerators, so it is exact."""

    def __init__(self, name: str, seed: int):
        self.name, self.seed = name, seed

    def _values(self, texts: list[str]) -> list[float]:
        return super().__call__([f"{self.name}{self.seed}:{t}" for t in texts])

    def start(self) -> bytes:
        return b"0 0"

    def fold(self, state: bytes, texts: list[str]) -> bytes:
        return self.merge(state, b"%d %d" % (len(texts), sum(int(v * 4294967296) for v in self._values(texts))))

    def merge(self, left: bytes, right: bytes) -> bytes:
        return b"%d %d" % tuple(int(a) + int(b) for a, b in zip(left.split(), right.split(), strict=True))

    def score(self, state: bytes, texts: list[str]) -> list[float]:
        n, total = map(int, state.split())
        return [v - total / 4294967296 / n for v in self._values(texts)]


class Blanks:
    """A surrogate that gives (a quarter of the blanks, blanks) of each text."""

    name = "blanks"

    def __call__(self, texts: list[str]) -> list[tuple[float, int]]:
        return [(0.25 * t.count(" "), t.count(" ")) for t in texts]


class Retrying:
    """A scorer that may fail for a while: up to ``attempts`` calls for each batch."""

    def __init__(self, inner: Scorer, attempts: int = 3):
        self.inner, self.attempts, self.name = inner, attempts, inner.name

    def __call__(self, texts: list[str]) -> list[float]:
        for left in range(self.attempts - 1, -1, -1):
            try:
                return self.inner(texts)
            except (OSError, TimeoutError):
                if not left:
                    raise
        return []


class Command:
    """A scorer that is a program: texts go to a file, a line each, and as many numbers come back, a line each, in order.

    ``command`` is run for every batch with the paths of the two files behind its arguments; the files are removed
    whatever happens. ``run`` can be replaced in tests.
    """

    def __init__(self, name: str, command: list[str], timeout: float = 3600.0, run: Callable = subprocess.run):
        self.name, self.command, self.timeout, self.run = name, command, timeout, run

    def preflight(self) -> None:
        """Raise unless the program answers to ``--help``."""
        if self.run([*self.command, "--help"], capture_output=True, timeout=self.timeout).returncode:
            raise Violation(f"{self.name}: {self.command[0]} does not start")

    def __call__(self, texts: list[str]) -> list[float]:
        with tempfile.TemporaryDirectory() as folder:
            source, target = Path(folder) / "texts.txt", Path(folder) / "scores.txt"
            source.write_text("".join(" ".join(t.split()) + "\n" for t in texts), encoding="utf-8")
            done = self.run([*self.command, str(source), str(target)], capture_output=True, timeout=self.timeout)
            if done.returncode:
                raise Violation(f"{self.name} ended with {done.returncode}: {done.stderr.decode(errors='replace')[-500:]}")
            lines = target.read_text().split("\n") if target.exists() else []
        return [float(x) for x in lines if x.strip()]


class Judge:
    """A chat model behind an HTTP interface that answers a fixed prompt with JSON; ``schema`` is what its answer must satisfy.

    ``field`` of the answer is the score. The same texts are judged the same: the seed and temperature are fixed, and
    ``steady`` asks twice. An answer that breaks the schema is asked for again, ``attempts`` times in all.
    """

    def __init__(self, name: str, url: str, prompt: str, schema: dict, field: str = "score", seed: int = 7, attempts: int = 3, timeout: float = 120.0, send: Callable | None = None):
        self.name, self.url, self.prompt, self.schema, self.field = name, url, prompt, schema, field
        self.seed, self.attempts, self.timeout, self.send = seed, attempts, timeout, send or self._post

    def request(self, text: str) -> dict:
        return {"model": self.name, "stream": False, "format": self.schema, "options": {"seed": self.seed, "temperature": 0}, "messages": [{"role": "user", "content": self.prompt.replace("{text}", text)}]}

    def _post(self, body: dict) -> dict:
        ask = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})  # noqa: S310
        with urllib.request.urlopen(ask, timeout=self.timeout) as answer:  # noqa: S310
            return json.load(answer)

    def judge(self, text: str) -> dict:
        wrong = []
        for _ in range(self.attempts):
            said = self.send(self.request(text))["message"]["content"]
            try:
                value = json.loads(said)
            except ValueError:
                wrong = ["not JSON"]
                continue
            if not (wrong := schema_errors(value, self.schema)):
                return value
        raise Violation(f"{self.name}: {'; '.join(wrong)}")

    def steady(self, texts: list[str]) -> bool:
        """Whether each text is judged the same twice."""
        return all(self.judge(t) == self.judge(t) for t in texts)

    def __call__(self, texts: list[str]) -> list[float]:
        return [float(self.judge(t)[self.field]) for t in texts]


def gathered(batches: Iterator[pa.RecordBatch], rows: int, most: int = 1 << 28) -> Iterator[pa.RecordBatch]:
    """Batches of just ``rows`` rows from Arrow's own smaller ones; fewer only at a partition's end, or where ``most`` bytes come first."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for whole in batches:
        start = 0
        while start < whole.num_rows:
            part = whole.slice(start, rows - n)
            held, n, size, start = [*held, part], n + part.num_rows, size + part.get_total_buffer_size() * part.num_rows // max(1, whole.num_rows), start + part.num_rows
            if n == rows or size >= most:
                yield _joined(held)
                held, n, size = [], 0, 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def score(rows: DataFrame, scorer: Scorer, text: str = "text", out: str = "score", batch: int = 25_000, kind: T.DataType | None = None) -> DataFrame:
    """All rows with a score; the row travels with its text, so nothing is matched by position. A wrong count raises.

    The scorer is called with ``batch`` texts at a time (``gathered``). ``kind``: the type of what it gives for a text, a double unless it is, say, a struct.
    """
    kind = kind or T.DoubleType()
    schema = T.StructType([*rows.schema.fields, T.StructField(out, kind)])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, batch):
            got = scorer([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])
            if len(got) != part.num_rows:
                raise Violation(f"{scorer.name} gave {len(got)} scores for {part.num_rows} texts")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, arrow)], names=[*part.schema.names, out])

    return rows.mapInArrow(run, schema)


#: Of one target: blocks have about so many texts, and so many states meet in one step of the tree.
BLOCK, FAN = 20_000, 16


def adapted(rows: DataFrame, adapter: Adapter, key: str, by: str, text: str = "text", least: int = 50, block: int = BLOCK) -> DataFrame:
    """``by, state``: the adapter's state for each target, folded from all its texts in an order that no partitioning changes.

    A target's texts are dealt by digest to blocks of about ``block`` texts; a block is folded in order of key and text, and states of blocks
    are merged, ``FAN`` neighbours at a time, until one is left. Targets of fewer than ``least`` texts, and a null target, are refused: an adapter would index beyond them.
    """
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("texts")).withColumn("blocks", F.ceil(F.col("texts") / block).cast("long"))
    require(sizes.where((F.col("texts") < least) | F.col(by).isNull()), f"targets of fewer than {least} texts")
    own = F.pmod(F.xxhash64("key", "text"), F.col("blocks")).alias("block")
    dealt = rows.select(F.col(by), F.col(key).cast("string").alias("key"), F.col(text).alias("text")).join(sizes, by).select(by, own, "key", "text")
    target, kind = to_arrow_type(rows.schema[by].dataType), rows.schema[by].dataType

    def emit(states: list[tuple], names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*states, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], target), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, b""
        for batch in batches:
            names = batch.column(0).to_pylist()
            blocks, texts = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            start = 0
            while start < len(texts):
                end = start
                while end < len(texts) and (names[end], blocks[end]) == (names[start], blocks[start]):
                    end += 1
                if now != (names[start], blocks[start]):
                    if now is not None:
                        yield emit([(*now, state)], [by, "block", "state"])
                    now, state = (names[start], blocks[start]), adapter.start()
                for t in texts[start:end]:  # one by one: where a batch ends must not matter
                    state = adapter.fold(state, [t or ""])
                start = end
        if now is not None:
            yield emit([(*now, state)], [by, "block", "state"])

    schema = T.StructType([T.StructField(by, kind), T.StructField("block", T.LongType()), T.StructField("state", T.BinaryType())])
    states = written(dealt.repartition(by, "block").sortWithinPartitions(by, "block", "key", "text").mapInArrow(fold, schema), "states")
    while (states.agg(F.max("block")).first()[0] or 0) > 0:
        listed = states.groupBy(by, F.floor(F.col("block") / FAN).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "state"))).alias("all"))  # FAN at most

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                merged = []
                for all_ in batch.column(2).to_pylist():
                    state = all_[0]["state"]
                    for nxt in all_[1:]:
                        state = adapter.merge(state, nxt["state"])
                    merged.append(state)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(merged, pa.binary())], names=[by, "block", "state"])

        states = written(listed.mapInArrow(merge, schema), "states")
    return states.select(by, "state")


#: Bytes of states that one broadcast may hold.
STATES = 1 << 28


def score_adapted(rows: DataFrame, adapter: Adapter, key: str, by: str, text: str = "text", out: str = "score", least: int = 50, block: int = BLOCK, batch: int = 25_000, most: int = STATES) -> DataFrame:
    """Rows with the scores of an adapter that has seen all texts of each row's target first; the same on any partitioning.

    The states go to the executors as one broadcast if they have ``most`` bytes at most together, else as several, each
    with the rows of its targets; the driver lists the targets and the sizes of their states.
    """
    states, out_rows = adapted(rows, adapter, key, by, text, least, block), None
    groups: list[list] = [[]]
    held = 0
    for name, size in states.select(by, F.length("state")).orderBy(by).collect():
        if groups[-1] and held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += size
    for names in groups:
        some, own = (rows, states) if len(groups) == 1 else (rows.where(F.col(by).isin(names)), states.where(F.col(by).isin(names)))
        part = _scored_with(some, adapter, dict(map(tuple, own.collect())), by, text, out, batch)
        out_rows = part if out_rows is None else out_rows.unionByName(part)
    return out_rows


def _scored_with(rows: DataFrame, adapter: Adapter, states: dict, by: str, text: str, out: str, batch: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, batch):
            texts, names = (part.column(part.schema.get_field_index(c)).to_pylist() for c in (text, by))
            got, places = [0.0] * part.num_rows, {}
            for i, name in enumerate(names):
                places.setdefault(name, []).append(i)
            for name, at in places.items():
                values = adapter.score(shared.value[name], [texts[i] or "" for i in at])
                if len(values) != len(at):
                    raise Violation(f"{adapter.name} gave {len(values)} scores for {len(at)} texts")
                for i, value in zip(at, values, strict=True):
                    got[i] = value
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def percentiles(rows: DataFrame, scorer: Scorer, text: str = "text", out: str = "result") -> DataFrame:
    """Rows with ``struct<percent, units, no_unit>`` of a scorer that gives (percent, units) for each text; without units the percent is null."""

    class Structured:
        name = scorer.name

        def __call__(self, texts):
            return [{"percent": p if n else None, "units": n, "no_unit": not n} for p, n in scorer(texts)]

    kind = T.StructType([T.StructField("percent", T.DoubleType()), T.StructField("units", T.LongType()), T.StructField("no_unit", T.BooleanType())])
    return score(rows, Structured(), text, out, kind=kind)


def runs(rows: DataFrame, scorers: list[Scorer | Adapter], text: str = "text", least: int = 50, allowed: bool = False, key: str | None = None, by: str | None = None) -> DataFrame:
    """Rows times runs, with ``run_id`` (from 1) and ``score``: for scorers whose results differ from run to run.

    An ``Adapter`` sees all texts of each target (``by``) before it scores; other scorers are called batch by batch and must not adapt to what they are
    given. Fewer than ``least`` rows are refused, in all or, with ``by``, for a target; and so is every run unless ``allowed`` says that it is meant.
    """
    if not allowed:
        raise Violation("this scorer runs only where its configuration says so")
    if (n := rows.limit(least).count()) < least:
        raise Violation(f"{n} rows, of at least {least}")
    out = None
    for i, scorer in enumerate(scorers, 1):
        if hasattr(scorer, "fold"):
            if key is None or by is None:
                raise Violation(f"{scorer.name} adapts to a target: say which key and target rows have")
            one = score_adapted(rows, scorer, key, by, text, least=least)
        else:
            one = score(rows, scorer, text)
        one = one.withColumn("run_id", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def covered(rows: DataFrame, scorer: Scorer, key: str, identity: Callable[[], None] | None = None, text: str = "text") -> DataFrame:
    """The whole execution: identity check, scores, written once, and every row covered by one finite score; else a violation."""
    if identity is not None:
        identity()
    got = written(score(rows, scorer, text), "scored")
    require(got.where(F.col("score").isNull() | F.isnan("score")).select(key), "not scored")
    require(rows.select(key).exceptAll(got.select(key)), "rows without a score")
    return got


def edited(cases: DataFrame, editor: Callable[[list[str], int], list[str]], gate: Callable[[DataFrame], DataFrame], key: list[str], text: str = "original", most: int = 3) -> DataFrame:
    """The attempt log of an editor: ``key..., attempt, edited, reasons, accepted``; a case is tried until its gate has no reasons, ``most`` times at most.

    ``editor`` gets the texts of a batch and the attempt's number, and gives as many texts. ``gate`` adds ``gate_reasons``, an array, to the
    rows with their ``edited`` text. Each round is written, so a lost executor repeats a task of one round and no accepted
    case is edited again; the number of rounds is bounded. Cases with a null text are not tried.
    """
    log, pending = None, cases.where(F.col(text).isNotNull())
    for attempt in range(1, most + 1):

        class Round:
            name = "editor"

            def __call__(self, texts, attempt=attempt):
                return editor(texts, attempt)

        made = gate(score(pending, Round(), text, "edited", kind=T.StringType()))
        done = written(made.withColumn("attempt", F.lit(attempt)).select(*cases.columns, "attempt", "edited", F.col("gate_reasons").alias("reasons"), (F.size("gate_reasons") == 0).alias("accepted")), "attempts")
        log = done if log is None else log.union(done)
        pending = done.where("not accepted").select(*cases.columns)
        if pending.isEmpty():
            break
    return log.select(*key, "attempt", "edited", "reasons", "accepted")


def unscored(rows: DataFrame, have: DataFrame, key: str = "sent_id", text: str = "text") -> DataFrame:
    """Rows without a score for the same content: the cache is keyed by id and digest, not by a count of lines."""
    return rows.withColumn("content_id", F.sha2(text, 256)).join(have.select(key, "content_id"), [key, "content_id"], "left_anti")
