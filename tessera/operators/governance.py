"""Frozen configurations, schemas, checksums and dispositions; small driver-side objects that gate a run."""

from __future__ import annotations

import copy
import hashlib
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import Violation


def canonical(value: Any) -> bytes:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def canonical_sha256(value: Any) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


class _Rules:
    """JSON Schema's assertions, a method for each keyword; it yields (place within the value, what is wrong)."""

    is_a = {
        "null": lambda v: v is None,
        "boolean": lambda v: isinstance(v, bool),
        "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or (isinstance(v, float) and v.is_integer())),
        "number": lambda v: not isinstance(v, bool) and isinstance(v, (int, float)),
        "string": lambda v: isinstance(v, str),
        "array": lambda v: isinstance(v, list),
        "object": lambda v: isinstance(v, dict),
    }
    #: What a keyword speaks of; of other values it says nothing.
    subject = {
        "minimum": "number", "maximum": "number", "exclusiveMinimum": "number", "exclusiveMaximum": "number", "minLength": "string", "maxLength": "string", "pattern": "string",
        "minItems": "array", "maxItems": "array", "uniqueItems": "array", "items": "array", "required": "object", "properties": "object", "additionalProperties": "object",
    }
    #: Annotations; they assert nothing.
    silent = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}

    def type(self, v, names, schema):
        names = [names] if isinstance(names, str) else names
        if not any(self.is_a[n](v) for n in names):
            yield "", f"not of type {'/'.join(names)}"

    def const(self, v, only, schema):
        if canonical(v) != canonical(only):
            yield "", f"not {only!r}"

    def enum(self, v, allowed, schema):
        if canonical(v) not in map(canonical, allowed):
            yield "", f"not one of {allowed!r}"

    def minimum(self, v, least, schema):
        if v < least:
            yield "", f"below {least}"

    def maximum(self, v, most, schema):
        if v > most:
            yield "", f"above {most}"

    def exclusiveMinimum(self, v, bound, schema):  # noqa: N802  the keyword's name
        if v <= bound:
            yield "", f"not above {bound}"

    def exclusiveMaximum(self, v, bound, schema):  # noqa: N802
        if v >= bound:
            yield "", f"not below {bound}"

    def _size(self, v, bound, sign, unit):
        if sign * len(v) > sign * bound:
            yield "", f"{len(v)} {unit}"

    def minLength(self, v, n, schema):  # noqa: N802
        return self._size(v, n, -1, "characters")

    def maxLength(self, v, n, schema):  # noqa: N802
        return self._size(v, n, 1, "characters")

    def minItems(self, v, n, schema):  # noqa: N802
        return self._size(v, n, -1, "items")

    def maxItems(self, v, n, schema):  # noqa: N802
        return self._size(v, n, 1, "items")

    def uniqueItems(self, v, wanted, schema):  # noqa: N802
        if wanted and len(set(map(canonical, v))) < len(v):
            yield "", "repeated items"

    def pattern(self, v, regex, schema):
        if re.search(regex, v) is None:
            yield "", f"does not match {regex}"

    def items(self, v, each, schema):
        for i, x in enumerate(v):
            yield from ((f"[{i}]{at}", said) for at, said in self(x, each))

    def required(self, v, names, schema):
        yield from (("", f"{n} is missing") for n in names if n not in v)

    def properties(self, v, known, schema):
        for n in sorted(v.keys() & known.keys()):
            yield from ((f".{n}{at}", said) for at, said in self(v[n], known[n]))

    def additionalProperties(self, v, rule, schema):  # noqa: N802
        for n in sorted(v.keys() - schema.get("properties", {}).keys()):
            if rule is False:
                yield "", f"{n} is not allowed"
            elif isinstance(rule, dict):
                yield from ((f".{n}{at}", said) for at, said in self(v[n], rule))

    def __call__(self, v, schema):
        """All violations; a value of the wrong type is told that alone."""
        if unknown := sorted(k for k in schema if k not in self.silent and k not in _KEYWORDS):
            raise ValueError(f"schema keywords that are not checked: {', '.join(unknown)}")
        if "type" in schema and (wrong := list(self.type(v, schema["type"], schema))):
            yield from wrong
            return
        for k in schema:
            if k in _KEYWORDS and k != "type" and (k not in self.subject or self.is_a[self.subject[k]](v)):
                yield from getattr(self, k)(v, schema[k], schema)


_KEYWORDS = {"type", "const", "enum"} | _Rules.subject.keys()


def schema_errors(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What in a value violates a JSON Schema, each with its place; keywords that are not checked, ``$ref`` among them, are refused."""
    return [f"{at}{place}: {said}" for place, said in _Rules()(value, schema)]


def payload_errors(rows: DataFrame, payload: str, schema: dict, out: str = "errors") -> DataFrame:
    """Rows with what violates the schema in their JSON payload, an empty array if nothing; null payloads, and what is no JSON, say so."""

    @F.pandas_udf("array<string>")
    def check(texts: pd.Series) -> pd.Series:
        def each(text):
            try:
                return schema_errors(json.loads(text), schema)
            except (TypeError, ValueError):
                return ["$: no JSON"]

        return texts.map(each)

    list(_Rules()(None, schema))  # an unknown keyword is refused before anything runs
    return rows.withColumn(out, check(F.col(payload)))


def override(base: dict, changes: dict[str, Any], allowed: set[str]) -> dict:
    """A copy of the protocol with values at JSON pointers replaced; only pointers in ``allowed`` that exist."""
    out = copy.deepcopy(base)
    for pointer, value in changes.items():
        if pointer not in allowed:
            raise Violation(f"override not permitted: {pointer}")
        *path, last = [p.replace("~1", "/").replace("~0", "~") for p in pointer.lstrip("/").split("/")]
        at: Any = out
        for p in path:
            at = at[int(p)] if isinstance(at, list) else at[p]
        if isinstance(at, dict) and last not in at:
            raise Violation(f"no such value: {pointer}")
        at[int(last) if isinstance(at, list) else last] = value
    return out


def frozen(config: dict, expected: dict) -> None:
    """Raise unless the named values of a configuration are exactly those that were frozen."""
    if bad := {k: (config.get(k), v) for k, v in expected.items() if config.get(k) != v}:
        raise Violation(f"configuration changed: {bad}")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, size_bytes, sha256`` of the files under a path, hashed by the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def checksum_violations(found: DataFrame, contract: DataFrame) -> DataFrame:
    """Files of the contract ``(name, size_bytes, sha256)`` that are missing or differ; names are the ends of paths."""
    f = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("size_bytes").alias("s"), F.col("sha256").alias("h"))
    return contract.join(f, "name", "left").where("h is null or s <> size_bytes or h <> sha256").select("name", "size_bytes", "sha256", "s", "h")


def provenance(files: DataFrame, sources: dict[str, dict]) -> str:
    """JSON of where each corpus comes from: its source (type, address, revision, licence) and what was read of it.

    ``files``: ``corpus_id, path, size_bytes, sha256``. Of each corpus the number of files, their bytes and a digest that does not
    depend on their order: the sum of the files' digests. A corpus without a source, or a source without files, raises.
    """
    part = F.conv(F.substring(F.sha2(F.concat_ws("\n", "path", "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    found = {r["corpus_id"]: r for r in files.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.sum(part).alias("digest")).collect()}  # a row a corpus
    if found.keys() != sources.keys():
        raise Violation(f"corpora and sources differ: {sorted(found.keys() ^ sources.keys())}")
    record = {c: {**sources[c], "files": r["files"], "bytes": r["bytes"], "digest": f"{int(r['digest']):x}"} for c, r in found.items()}
    return json.dumps(record, sort_keys=True, indent=1, ensure_ascii=False)


def preflight(identity: dict[str, Any], expected: dict[str, Any], alone: tuple[str, list[str]] | None = None) -> None:
    """Raise unless a model is the frozen one: tag, digest, licence and whatever else is named; ``alone``: its name and what is loaded, which must be just that."""
    wrong = {k: (identity.get(k), v) for k, v in expected.items() if identity.get(k) != v}
    if wrong:
        raise Violation(f"another model: {wrong}")
    if alone is not None and alone[1] != [alone[0]]:
        raise Violation(f"loaded besides {alone[0]}: {sorted(set(alone[1]) - {alone[0]})}")


def disposition(bindings: dict[str, str], expected: dict[str, str], checks: dict[str, bool], waivers: set[str]) -> str:
    """accepted, waived or withheld: bindings must be equal; failed checks must each have a waiver."""
    if bindings != expected:
        return "withheld"
    failed = {k for k, ok in checks.items() if not ok}
    return "accepted" if not failed else "waived" if failed <= waivers else "withheld"
