"""Canonical JSON and hashes of inputs and prompts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value) -> str:
    """Keys sorted by code point, no blanks, no escapes beyond JSON's own."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _canonical_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    for s in texts:
        yield s.map(one, na_action=None)


def canonical_json(text: Column | str) -> Column:
    """Bit-exact canonical form of JSON texts; null for what is none. Built-in
    functions sort keys by UTF-16 unit and print numbers otherwise."""
    return F.pandas_udf(_canonical_batches, "string")(text)


def _hash_batches(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(workflow, evidence, options, policy):
        try:
            pairs = json.loads(options, object_pairs_hook=lambda kv: [list(x) for x in kv])
            body = {"workflow": workflow, "evidence": json.loads(evidence), "options_pairs": pairs, "policy_text": policy}
        except (TypeError, ValueError):
            return None
        return hashlib.sha256(canonical(body).encode()).hexdigest()

    for columns in batches:
        yield pd.Series([one(*row) for row in zip(*columns)])


def input_hash(workflow: Column | str, evidence: Column | str, options: Column | str, policy: Column | str) -> Column:
    """SHA-256 of canonical {workflow, evidence, options_pairs, policy_text}.
    Options are pairs in the order of the text; null where a part is no JSON."""
    return F.pandas_udf(_hash_batches, "string")(workflow, evidence, options, policy)


def instruction_text(policy: Column, suffix: str) -> Column:
    """Policy and suffix, with a blank between unless the policy ends with white space."""
    return F.concat(policy, F.when(policy.rlike(r"\s\z"), "").otherwise(" "), F.lit(suffix))


def chat_body(model: Column, instruction: Column, evidence: Column, temperature: float = 0.0) -> Column:
    """The body of a chat request, as JSON text: an instruction, and evidence as the user's message."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(model.alias("model"), F.array(message("system", instruction), message("user", evidence)).alias("messages"), F.lit(temperature).alias("temperature"))).alias("body")


def prompt_hash(body: Column) -> Column:
    """SHA-256 of a body's canonical form without its model: two models asked alike have one hash."""
    return F.sha2(canonical_json(_without_model(body)), 256)


def _without_model(body: Column) -> Column:
    fields = F.from_json(body, "map<string,string>")
    return F.to_json(F.map_filter(fields, lambda k, v: k != "model"))
