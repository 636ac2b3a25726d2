"""Driver-side text for model calls: templates, answers, stable ids."""

from __future__ import annotations

import hashlib
import json
import re
import string


def required_fields(template: str) -> set[str]:
    """Names of the fields a template needs."""
    return {name for _, name, _, _ in string.Formatter().parse(template) if name}


def fill(template: str, **values: str) -> str:
    """A filled template; a missing field is an error that names it."""
    missing = required_fields(template) - values.keys()
    if missing:
        raise ValueError(f"missing fields: {sorted(missing)}")
    return template.format(**values)


def prompt_hash(*parts: str) -> str:
    """First 16 hexadecimal digits over the texts of a prompt."""
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]


def json_object(answer: str) -> dict:
    """The JSON object in an answer, with or without a code fence or words around it."""
    inner = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    text = inner.group(1) if inner else answer
    begin, end = text.find("{"), text.rfind("}")
    if begin < 0 or end < begin:
        raise ValueError("no JSON object")
    found = json.loads(text[begin : end + 1])
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def concept_id(run: str, cluster: int, name: str, prompt: str) -> str:
    """Stable id of a concept."""
    return "concept_" + hashlib.sha256(json.dumps([run, cluster, name, prompt], ensure_ascii=False).encode()).hexdigest()[:24]


def check_examples(example_ids: list[str], members: set[str]) -> None:
    """Examples given for a cluster must be its members."""
    foreign = [e for e in example_ids if e not in members]
    if foreign:
        raise ValueError(f"examples from outside the cluster: {foreign[:5]}")
