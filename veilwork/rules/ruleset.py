"""Rule documents: merge, level and order resolution, and the compiled detectors.

Everything here runs on the driver before a Spark plan exists and handles names and
patterns only, never data rows.
"""

from __future__ import annotations

import copy
import json
import re
import warnings
from dataclasses import dataclass, field, replace
from pathlib import Path

from veilwork.rules import dialect
from veilwork.rules.shipped import shipped_rules

TOKEN_RULE = "_TOKEN_MAP_"


class RuleError(ValueError):
    """The rule document cannot be used as asked."""


@dataclass(frozen=True)
class Detector:
    """One compiled detection step.  ``kind``: pattern, tokens, spans, phrase_table or custom."""
    rule_ix: int
    rule: str
    label: str | None
    kind: str
    pattern: str = ""
    group: int = 0                   # 0 = whole match
    lead_groups: int = 0
    needs: str = ""                  # a literal without which the pattern cannot match
    params: dict = field(default_factory=dict, compare=False)


def deep_merge(base: dict, extra: dict) -> dict:
    """Dictionaries merge, everything else (lists too) is replaced by the later document."""
    for key, value in extra.items():
        if isinstance(value, dict) and isinstance(base.get(key), dict):
            deep_merge(base[key], value)
        else:
            base[key] = copy.deepcopy(value)
    return base


def kind_of(model_class: str) -> str:
    """``pkg.RedactorRegex`` and ``regex`` name the same kind."""
    return re.sub(r"^(Redactor|Anon)(?=[A-Z])", "", model_class.split(".")[-1]).lower()


def read_document(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml
    return yaml.safe_load(text)


class RuleSet:
    """The merged rules of one run."""

    def __init__(self, *documents: dict, defaults: bool = True, street_suffixes=()):
        if not defaults and not documents:
            raise RuleError("no rules loaded")
        self.doc = shipped_rules(street_suffixes) if defaults else {}
        for d in documents:
            deep_merge(self.doc, d)
        tokens = self.doc.get("token-map") or {}
        if tokens:
            block = {"token-map": tokens}
            deep_merge(self.doc, {"entities": {TOKEN_RULE: {"redactor": {
                "model-class": "tokenmap", "text": block, "voice": block}}}})

    @classmethod
    def from_files(cls, *paths: str, defaults: bool = True) -> "RuleSet":
        return cls(*[read_document(p) for p in paths], defaults=defaults)

    # -- names -------------------------------------------------------------------------
    def level(self, name) -> list[str]:
        levels = self.doc.get("level", {})
        if str(name) not in levels:
            raise RuleError(f"level {name!r} is not defined")
        entries = list(levels[str(name)])
        return entries if TOKEN_RULE in entries else [TOKEN_RULE] + entries

    @property
    def always_redact(self) -> list[str]:
        return list(self.doc.get("always-redact") or [TOKEN_RULE])

    @property
    def always_anonymize(self) -> list[str]:
        return list(self.doc.get("always-anonymize", ["_IGNORE_"]))

    @property
    def full_order(self) -> list[str]:
        order = list(self.doc.get("redaction-order") or [])
        if not order:
            raise RuleError("redaction-order is not defined")
        return [r for r in self.always_redact if r not in order] + order

    def redaction_order(self, level, redact: bool = True) -> list[str]:
        members, order = self.level(level), self.full_order
        missing = [m for m in members if m not in order]
        if missing:
            raise RuleError(f"entities without a place in redaction-order: {missing}")
        return [r for r in order if r in members] if redact else self.always_redact

    def anonymization_order(self, level, anonymize: bool) -> list[str]:
        order = self.doc.get("anonymization-order") or self.full_order
        wanted = self.level(level) if anonymize else self.always_anonymize
        return [r for r in order if r in wanted]

    def aliases(self) -> dict[str, list[str]]:
        """F16: entity -> label names it answers for; every entity answers for itself by default."""
        given = dict(self.doc.get("anon-map") or {})
        for name in self.doc.get("anonymization-order") or self.full_order:
            given.setdefault(name, [name])
        return given

    def tokens(self) -> dict[str, list[str]]:
        return dict(self.doc.get("token-map") or {})

    def block(self, entity: str, side: str) -> dict | None:
        entities = self.doc.get("entities", {})
        if entity not in entities:
            if entity == TOKEN_RULE:
                return None
            # The model-only labels may come without any entry of their own.
            raise RuleError(f"entity {entity!r} is not defined")
        return (entities[entity] or {}).get(side)

    # -- patterns ----------------------------------------------------------------------
    def pattern_set(self, rule_id: str, seen: tuple = ()) -> list[str]:
        """The patterns of a regex id, with includes resolved."""
        if rule_id in seen:
            raise RuleError(f"include cycle through {rule_id!r}")
        found = self.doc.get("regex", {}).get(rule_id)
        if found is None:
            raise RuleError(f"regex {rule_id!r} is not defined")
        return self._included([found] if isinstance(found, str) else list(found), seen + (rule_id,))

    def _included(self, found: list[str], seen: tuple = ()) -> list[str]:
        return [re.sub(r"\?INCLUDE<([^>]*)>", lambda m: self.pattern_set(m.group(1), seen)[0], p) for p in found]

    def patterns_in(self, params: dict) -> list[str]:
        if params.get("regex-id") is not None:
            return self.pattern_set(params["regex-id"])
        if params.get("regex") is not None:
            given = params["regex"]
            return self._included([given] if isinstance(given, str) else list(given))
        raise RuleError("a regex rule needs 'regex' or 'regex-id'")

    # -- detectors ---------------------------------------------------------------------
    def detectors(self, modality: str, level=2, redact: bool = True, spark=None) -> list[Detector]:
        """All detection steps in order.  A rule with a bad pattern is dropped with a warning."""
        from veilwork.operators.registry import DETECTORS
        out = []
        for rule_ix, rule in enumerate(self.redaction_order(level, redact)):
            block = self.block(rule, "redactor")
            if not block:
                continue
            kind, params = kind_of(block["model-class"]), block.get(modality)
            if kind in ("spacy", "spans"):
                out.append(Detector(rule_ix, rule, None, "spans", params={
                    "labels": self.level(level), "split": ["PERSON"], **(params or {})}))
                continue
            if kind in DETECTORS:
                out.append(Detector(rule_ix, rule, rule, "custom", params={
                    "fn": DETECTORS[kind], **(params or {})}))
                continue
            if params is None:
                continue
            try:
                out += self._compile(rule_ix, rule, kind, params, spark)
            except (dialect.PatternError, re.error) as exc:
                warnings.warn(f"rule {rule} dropped: {exc}")
        return out

    def _compile(self, rule_ix, rule, kind, params, spark) -> list[Detector]:
        if kind == "tokenmap":
            flags = dialect.flag_letters(params.get("flags", []))
            return compile_tokens(rule_ix, rule, params.get("token-map", {}), flags)
        flags = dialect.flag_letters(params.get("flags", ["IGNORECASE"]))
        if kind == "regex":
            found, group = self.patterns_in(params), params.get("group", 1)
            if params.get("single-regex", True):
                found = [dialect.alternation(found)]
            return [compile_pattern(rule_ix, rule, p, flags, group, needs=params.get("needs", ""))
                    for p in found]
        if kind in ("phraselist", "phrasedict"):
            from veilwork.sources.phrases import rule_phrases
            edge = [r"\b"] if params.get("add-wordbreak", True) else [""]
            pre = dialect.alternation(self.patterns_in(params["prematch"]) if params.get("prematch") else edge)
            post = dialect.alternation(self.patterns_in(params["postmatch"]) if params.get("postmatch") else edge)
            phrases = rule_phrases(params, spark)
            if not isinstance(phrases, list):
                return [Detector(rule_ix, rule, rule, "phrase_table", params={"table": phrases})]
            if not phrases:
                raise RuleError(f"empty phrase list for {rule}")
            if params.get("combine-sets", True):
                phrases = [dialect.alternation(phrases)]
            return [compile_pattern(rule_ix, rule, pre + p + post, flags) for p in phrases]
        raise RuleError(f"rule {rule}: unknown detector {kind!r}")


def compile_pattern(rule_ix, rule, pattern, flags="i", group=1, label=None, needs="") -> Detector:
    """One detector pattern.  Group 1 stands for the whole match, as in the rule documents."""
    java, names, prefix = dialect.to_java(pattern, flags)
    lead = number = 0
    if group != 1:
        number = names.get(group) if isinstance(group, str) else int(group)
        if number is None:
            raise dialect.PatternError(f"no group named {group}")
        java, number, lead = dialect.capture_lead(java, number)
    return Detector(rule_ix, rule, label or rule, "pattern", prefix + java, number, lead, needs)


def compile_tokens(rule_ix, rule, token_map: dict, flags: str) -> list[Detector]:
    """One step for the whole map where its tokens can't overlap, else a step per label behind one gate."""
    maps = {label: [found] if isinstance(found, str) else list(found) for label, found in token_map.items()}
    maps = {label: found for label, found in maps.items() if found}
    if not maps:
        return []
    if apart(maps, "i" in flags):
        branches = "|".join("(" + "|".join(found) + ")" for found in maps.values())
        java, _, prefix = dialect.to_java(branches, flags)
        return [Detector(rule_ix, rule, None, "tokens", prefix + java, params={"labels": list(maps)})]
    steps = []
    for label, found in maps.items():
        try:
            steps.append(compile_pattern(rule_ix, rule, dialect.alternation(found), flags, label=label))
        except (dialect.PatternError, re.error) as exc:
            warnings.warn(f"tokens of {label} in {rule} dropped: {exc}")
    gate = "|".join(f"(?:{s.pattern})" for s in steps)
    return [replace(s, params={"gate": gate, "opens": i == 0}) for i, s in enumerate(steps)]


def apart(maps: dict[str, list[str]], fold: bool) -> bool:
    """Whether all tokens are plain text and none can share a character of the text with one of another label."""
    tokens = [(label, t.lower() if fold else t) for label, found in maps.items() for t in found]
    if not all(t and re.fullmatch(r"[^\\.^$*+?{}\[\]|()#\s]+", t) for _, t in tokens):
        return False
    meet = lambda u, v: u in v or any(u.endswith(v[:k]) for k in range(1, len(v)))
    return not any(a != b and (meet(u, v) or meet(v, u)) for a, u in tokens for b, v in tokens)
