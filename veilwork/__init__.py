"""veilwork: PII redaction and anonymisation of conversation tables as Spark jobs."""

from veilwork.plans.redaction import RedactionJob
from veilwork.rules.ruleset import RuleSet

__all__ = ["RedactionJob", "RuleSet"]
