"""Masking and access policy."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import named

REDACTED = "[REDACTED]"
#: Fixed value: how text begins that a spreadsheet runs.
FORMULA = r"^[\t\r\n ]*[=+\-@]"


def mask(df: DataFrame, fields: list[str], replacement: str = REDACTED) -> DataFrame:
    """Listed fields (trimmed, case ignored) show the replacement."""
    hidden = {f.strip().lower() for f in fields}
    return df.select(*((F.lit(replacement).alias(c) if c.lower() in hidden else named(c)) for c in df.columns))


def mask_differences(differences: DataFrame, fields: list[str], replacement: str = REDACTED) -> DataFrame:
    """Values of differences whose source field is listed show the replacement."""
    hidden = F.lower("field").isin([f.strip().lower() for f in fields])
    return differences.withColumns({c: F.when(hidden, F.lit(replacement)).otherwise(F.col(c)) for c in ("source_value", "target_value")})


def guard_formulas(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    return df.select(*((F.when(named(c).rlike(FORMULA), F.concat(F.lit("'"), named(c))).otherwise(named(c)).alias(c) if k == "string" else named(c)) for c, k in df.dtypes))


#: A name in which * stands for any text, or a pattern that is searched for.
Names = str | re.Pattern


def named_by(names: Names, value: str) -> bool:
    if isinstance(names, re.Pattern):
        return names.search(value) is not None
    return re.fullmatch(".*".join(map(re.escape, names.split("*"))), value, re.S) is not None


@dataclass
class PolicyRule:
    """What a request must be like for the rule to hold; conditions that are None do not count.

    Lists named `..._any` want one of the request's values to be named by them, `connectors_all` wants all of them to be.
    `mask` are fields whose values results of an allowed request do not show.
    """

    allow: bool = True
    tool: list[Names] | None = None
    connectors_any: list[Names] | None = None
    connectors_all: list[Names] | None = None
    write_mode: str | None = None
    select_any: list[Names] | None = None
    where_any: list[Names] | None = None
    record_any: list[Names] | None = None
    subject: list[Names] | None = None
    tenant: list[Names] | None = None
    roles_any: list[Names] | None = None
    scopes_any: list[Names] | None = None
    mask: list[str] = field(default_factory=list)
    reason: str | None = None

    def holds(self, asked: Asked) -> bool:
        some = ((self.tool, [asked.tool]), (self.connectors_any, asked.connectors), (self.select_any, asked.select), (self.where_any, asked.where), (self.record_any, asked.record), (self.subject, [asked.subject]), (self.tenant, [asked.tenant]), (self.roles_any, asked.roles), (self.scopes_any, asked.scopes))
        if any(names is not None and not any(v is not None and _listed(names, v) for v in values) for names, values in some):
            return False
        if self.connectors_all is not None and not (asked.connectors and all(_listed(self.connectors_all, c) for c in asked.connectors)):
            return False
        return self.write_mode is None or self.write_mode == asked.write_mode


@dataclass
class Asked:
    """A request as policies see it: the tool, the connectors it reaches, the fields it names and who asks."""

    tool: str
    connectors: list[str] = field(default_factory=list)
    write: bool = False
    write_mode: str | None = None
    select: list[str] = field(default_factory=list)
    where: list[str] = field(default_factory=list)
    record: list[str] = field(default_factory=list)
    subject: str | None = None
    tenant: str | None = None
    roles: list[str] = field(default_factory=list)
    scopes: list[str] = field(default_factory=list)


@dataclass
class Decision:
    """True if allowed. mask: fields that the rule which held hides."""

    allowed: bool
    reason: str
    mask: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return self.allowed


def _listed(names: list[Names], value: str) -> bool:
    return any(named_by(n, value) for n in names)


@dataclass
class Policy:
    """Tools and connectors have lists of their own; deny beats allow, a non-empty allow list is exclusive, else the default counts.

    The tool and each of the connectors must pass. Then the first rule that holds decides; rules may be written (tool, connector,
    allow) for short. `deny` names tools and connectors alike; of a request with an `allow` list the tool or a connector must be in it,
    besides what the lists of their own say. Masked fields are those of all results, of a connector, and of the rule that held.
    """

    deny: list[Names] = field(default_factory=list)
    allow: list[Names] = field(default_factory=list)
    deny_tools: list[Names] = field(default_factory=list)
    allow_tools: list[Names] = field(default_factory=list)
    deny_connectors: list[Names] = field(default_factory=list)
    allow_connectors: list[Names] = field(default_factory=list)
    rules: list[PolicyRule | tuple[Names, Names, bool]] = field(default_factory=list)
    default: bool = True
    writes: bool = True
    mask: list[str] = field(default_factory=list)
    mask_per_connector: dict[str, list[str]] = field(default_factory=dict)
    replacement: str = REDACTED

    def __post_init__(self):
        self.rules = [r if isinstance(r, PolicyRule) else PolicyRule(r[2], [r[0]], [r[1]]) for r in self.rules]

    def _passes(self, value: str, allow: list[Names], deny: list[Names]) -> bool:
        return not _listed([*self.deny, *deny], value) and (_listed(allow, value) if allow else self.default or bool(self.allow))

    def decide(self, tool: str, connectors: str | list[str] = (), write: bool = False, **context) -> Decision:
        """A decision on a request; `context` are further fields of Asked."""
        asked = Asked(tool, [connectors] if isinstance(connectors, str) else list(connectors), write, **context)
        if not self._passes(tool, self.allow_tools, self.deny_tools):
            return Decision(False, f"tool {tool} is not allowed")
        for c in asked.connectors:
            if not self._passes(c, self.allow_connectors, self.deny_connectors):
                return Decision(False, f"connector {c} is not allowed")
        if self.allow and not any(_listed(self.allow, v) for v in (tool, *asked.connectors)):
            return Decision(False, "neither the tool nor a connector is in the allow list")
        rule = next((r for r in self.rules if r.holds(asked)), PolicyRule())
        if not rule.allow:
            return Decision(False, rule.reason or "a rule denies it")
        if write and not self.writes:
            return Decision(False, "writes are not allowed")
        return Decision(True, rule.reason or "allowed", rule.mask)

    def masked(self, df: DataFrame, connector: str, decision: Decision | None = None) -> DataFrame:
        """A connector's result without the values that must not be seen."""
        return mask(df, [*self.mask, *self.mask_per_connector.get(connector, []), *(decision.mask if decision else [])], self.replacement)
