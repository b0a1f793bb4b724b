"""Options, policies and registries: checked when they are made, on the driver, before any plan is built."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from itertools import pairwise
from urllib.parse import urlsplit

# The names that results, failures and events use.
RESOLUTION_MODES = ("UNION", "PRIMARY", "PRIMARY_WITH_FALLBACK")
RESOLUTION_REASONS = ("SINGLE_EVIDENCE", "EXACT_MATCH", "COVERING_EVIDENCE", "OVERLAP_UNION", "TYPE_CONFLICT")
FAILURE_POLICIES = ("REQUIRE_ALL", "REQUIRE_PRIMARY", "ALLOW_PARTIAL")
OUTPUT_ACTIONS = ("TOKENIZE", "REDACT", "BLOCK")
BOUNDARIES = ("MODEL", "TOOL_INPUT", "TOOL_RESULT", "APPLICATION_OUTPUT")
OUTCOMES = ("PROTECTED", "DISCLOSED", "BLOCKED")
FALLBACK_TYPE = "PII"
DEFAULT_TYPES = "PII PERSON ORGANIZATION LOCATION EMAIL_ADDRESS PHONE_NUMBER NATIONAL_ID CREDIT_CARD DATE_TIME IP_ADDRESS URL IBAN_CODE CRYPTO NRP MEDICAL_LICENSE".split()

# Limits of the contract.
MAX_SPANS = 100_000
MAX_OUTPUT_CHARS = 8_000_000
MAX_DEPTH, MAX_NODES = 128, 100_000
MAX_STRING_CHARS, MAX_NUMBER_CHARS, MAX_INPUT_CHARS = 250_000, 1_000, 1_000_000
MAX_EXPANDED_NUMBER_CHARS = 4_096

TYPE_GRAMMAR = "[A-Z0-9]+(?:_[A-Z0-9]+)*"
_SEGMENTS = re.compile(r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*")


class ConfigError(ValueError):
    """A configuration that can't be used; the message never holds analysed text."""


def _must(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def entity_type(value: str) -> str:
    """The name itself if it fits the grammar; names are rejected, not repaired."""
    _must(isinstance(value, str) and len(value) <= 128 and re.fullmatch(TYPE_GRAMMAR, value) is not None, "malformed entity type")
    return value


def provider_id(value: str) -> str:
    """Upper-case form of a provider's name."""
    _must(isinstance(value, str) and len(value) <= 128 and _SEGMENTS.fullmatch(value) is not None, "malformed provider id")
    return value.upper()


def language_code(value: str) -> str:
    """Lower-case form of a language code."""
    _must(isinstance(value, str) and len(value) <= 64 and _SEGMENTS.fullmatch(value) is not None, "malformed language code")
    return value.lower()


def _distinct(values: Iterable[str], what: str) -> tuple[str, ...]:
    out = tuple(values)
    _must(len(set(out)) == len(out), f"duplicate {what}")
    return out


def _score(value: float) -> float:
    _must(0.0 <= value <= 1.0, "score outside [0, 1]")
    return float(value)


@dataclass(frozen=True)
class Registry:
    """Aliases (followed to their end) and trusted types."""

    aliases: Mapping[str, str] = field(default_factory=dict)
    trusted: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        closed = {}
        for label in self.aliases:
            entity_type(label)
            seen, at = {label}, label
            while at in self.aliases:
                at = entity_type(self.aliases[at])
                _must(at not in seen, "alias cycle")
                seen.add(at)
            closed[label] = at
        object.__setattr__(self, "aliases", closed)
        object.__setattr__(self, "trusted", frozenset(map(entity_type, {*DEFAULT_TYPES, *self.trusted, *closed.values()})))

    def resolve(self, label: str, own: Iterable[str] = ()) -> str:
        """Canonical type of a provider's label; ``own``: types that this provider declares."""
        at = self.aliases.get(entity_type(label), label)
        return at if at in self.trusted or at in own else FALLBACK_TYPE

    def require_trusted(self, label: str, own: Iterable[str] = ()) -> str:
        at = self.aliases.get(entity_type(label), label)
        _must(at in self.trusted or at in own, "type is not trusted")
        return at


@dataclass(frozen=True)
class Options:
    """Language, allow-list and global floor of an analysis."""

    language: str = "en"
    included: tuple[str, ...] = ()
    minimum_score: float = 0.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "language", language_code(self.language))
        object.__setattr__(self, "included", _distinct(map(entity_type, self.included), "allowed type"))
        _score(self.minimum_score)

    def allowed(self, registry: Registry, own: Iterable[str] = ()) -> tuple[str, ...]:
        """C4: canonical allow-list."""
        return _distinct((registry.require_trusted(t, own) for t in self.included), "allowed type after aliases")


@dataclass(frozen=True)
class Policy:
    """which providers count, and what their failures mean."""

    mode: str = "UNION"
    primary: str | None = None
    supplemental: tuple[str, ...] = ()
    failures: str = "REQUIRE_ALL"
    floors: Mapping[str, float] = field(default_factory=dict)
    fallback_type: str = FALLBACK_TYPE

    def __post_init__(self) -> None:
        _must(self.mode in RESOLUTION_MODES, "unknown mode")
        _must(self.failures in FAILURE_POLICIES, "unknown failure policy")
        object.__setattr__(self, "primary", self.primary and provider_id(self.primary))
        object.__setattr__(self, "supplemental", _distinct(map(provider_id, self.supplemental), "supplemental provider"))
        floors = [(provider_id(k), _score(v)) for k, v in self.floors.items()]
        _distinct((k for k, _ in floors), "provider floor")
        object.__setattr__(self, "floors", dict(floors))
        entity_type(self.fallback_type)
        needs = self.mode != "UNION" or self.failures == "REQUIRE_PRIMARY"
        _must(self.primary is not None or not needs, "a primary provider is needed")
        _must(self.primary not in self.supplemental, "the primary provider can't be supplemental")
        _must(self.mode != "PRIMARY_WITH_FALLBACK" or self.failures == "ALLOW_PARTIAL", "fallback needs ALLOW_PARTIAL")

    def check(self, providers: Iterable[str]) -> tuple[str, ...]:
        """Canonical ids of the configured providers, if this policy fits them."""
        known = _distinct(map(provider_id, providers), "provider")
        _must(bool(known), "no analyzer is configured")
        named = {*self.supplemental, *self.floors, *([self.primary] if self.primary else [])}
        _must(named <= set(known), "the policy names an unknown provider")
        rest = [p for p in known if p != self.primary and p not in self.supplemental]
        _must(self.mode != "PRIMARY" or not rest, "a provider can never be used")
        _must(self.mode != "PRIMARY_WITH_FALLBACK" or len(known) > 1, "fallback needs another provider")
        return known

    def stages(self, providers: Iterable[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Providers that always run, and those that run where the primary failed."""
        known = self.check(providers)
        if self.mode != "PRIMARY_WITH_FALLBACK":
            return known, ()
        first = tuple(p for p in known if p == self.primary or p in self.supplemental)
        return first, tuple(p for p in known if p not in first)


@dataclass(frozen=True)
class RegexRule:
    """A pattern whose matches (or whose group's matches) are spans of one type."""

    entity_type: str
    pattern: str
    score: float = 0.85
    capture_group: int = 0
    validator_id: str | None = None

    def __post_init__(self) -> None:
        entity_type(self.entity_type)
        _must(bool(self.pattern.strip()), "blank pattern")
        _score(self.score)
        _must(self.capture_group >= 0, "negative capture group")
        # counts opening groups without compiling: the pattern is of the engine's dialect, not Python's
        plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", self.pattern)
        _must(self.capture_group <= len(re.findall(r"\((?!\?)|\(\?<(?![=!])|\(\?P<", plain)), "no such capture group")
        _must(self.validator_id is None or re.fullmatch("[a-z0-9]+(?:-[a-z0-9]+)*", self.validator_id) is not None, "malformed validator id")

    def __repr__(self) -> str:
        return f"RegexRule({self.entity_type})"


@dataclass(frozen=True)
class RemoteConfig:
    """Endpoint, limits and headers of a remote detector."""

    url: str = "http://localhost:5002"
    timeout_s: float = 5.0
    retries: int = 1
    backoff_s: float = 0.3
    max_response_bytes: int = 8 << 20
    headers: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        at = urlsplit(self.url)
        _must(at.scheme in ("http", "https") and bool(at.hostname), "the endpoint must be http or https with a host")
        _must("@" not in at.netloc and not at.query and not at.fragment, "the endpoint can't have user info, query or fragment")
        _must(self.timeout_s > 0 and self.retries >= 0 and self.backoff_s >= 0 and self.max_response_bytes > 0, "limits must be positive")
        names = [n.lower() for n in self.headers]
        _must(len(set(names)) == len(names) and "content-type" not in names, "headers must be distinct and without Content-Type")
        for name, value in self.headers.items():
            _must(re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name) is not None and not re.search(r"[\r\n\0]", value), "malformed header")


@dataclass(frozen=True)
class OutputPolicy:
    enabled: bool = False
    action: str = "TOKENIZE"
    block_message: str = "Response blocked by policy."

    def __post_init__(self) -> None:
        _must(self.action in OUTPUT_ACTIONS, "unknown output action")


@dataclass(frozen=True)
class InspectionLimits:
    max_frames: int = 1_024
    max_characters: int = 1_000_000
    max_media_bytes: int = 16 << 20
    idle_seconds: float = 60.0

    def __post_init__(self) -> None:
        _must(min(self.max_frames, self.max_characters, self.max_media_bytes) > 0 and self.idle_seconds > 0, "limits must be positive")


@dataclass(frozen=True)
class Disclosures:
    """Tool name (exact, case-sensitive) -> entity types it may see; any other tool sees none."""

    by_tool: Mapping[str, frozenset[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for tool, types in self.by_tool.items():
            _must(bool(tool.strip()) and "*" not in tool, "tool names are exact")
            _must(bool(types), "an empty disclosure is not a disclosure")
        object.__setattr__(self, "by_tool", {t: frozenset(map(entity_type, v)) for t, v in self.by_tool.items()})

    def rows(self) -> list[tuple[str, str]]:
        return [(t, e) for t in sorted(self.by_tool) for e in sorted(self.by_tool[t])]


@dataclass(frozen=True)
class EngineConfig:
    """G1: all settings, with their defaults."""

    options: Options = Options()
    policy: Policy = Policy()
    registry: Registry = Registry()
    output: OutputPolicy = OutputPolicy()
    limits: InspectionLimits = InspectionLimits()
    disclosures: Disclosures = Disclosures()
    rules: tuple[RegexRule, ...] = ()
    remote: RemoteConfig | None = None
    #: Resolved validators by id.
    validators: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _must(bool(self.rules) or self.remote is not None, "no analyzer is configured")
        missing = {r.validator_id for r in self.rules if r.validator_id} - set(self.validators)
        _must(not missing, "unknown validator id")

    @classmethod
    def from_dict(cls, settings: Mapping, validators: Mapping[str, object] | None = None) -> EngineConfig:
        """From nested settings with hyphenated names; an unknown name is refused with its likeliest meaning."""
        parts = {"options": Options, "policy": Policy, "registry": Registry, "output": OutputPolicy, "limits": InspectionLimits, "remote": RemoteConfig}
        out: dict = {"validators": validators or {}}
        _known(settings, [*parts, "rules", "disclosures"])
        for name, kind in parts.items():
            if name in settings:
                out[name] = _from(kind, settings[name])
        out["rules"] = tuple(_from(RegexRule, r) for r in settings.get("rules", ()))
        if "disclosures" in settings:
            out["disclosures"] = Disclosures({k: frozenset(v) for k, v in settings["disclosures"].items()})
        return cls(**out)


def _known(given: Iterable[str], names: Iterable[str]) -> None:
    names = [n.replace("_", "-") for n in names]
    for name in given:
        if name.replace("_", "-") not in names:
            hint = closest_key(name, names)
            raise ConfigError(f"unknown setting '{name}'" + (f", did you mean '{hint}'?" if hint else ""))


def _from(kind: type, settings: Mapping):
    names = [f.name for f in fields(kind)]
    _known(settings, names)
    values = {k.replace("-", "_"): tuple(v) if isinstance(v, list) else v for k, v in settings.items()}
    return kind(**values)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *_next_row(row, i, x, b)]
    return row[-1]


def _next_row(row: list[int], i: int, x: str, b: str) -> list[int]:
    out, left = [], i
    for (up_left, up), y in zip(pairwise(row), b, strict=True):
        left = min(left + 1, up + 1, up_left + (x != y))
        out.append(left)
    return out


def closest_key(name: str, known: Iterable[str]) -> str | None:
    """The one nearest known name, within 1, 3 or 4 edits by its length; none if two are as near."""
    by = sorted((edit_distance(name, k), k) for k in set(known))
    if not by or (len(by) > 1 and by[0][0] == by[1][0]):
        return None
    distance, best = by[0]
    return best if distance <= typo_limit(len(best)) else None


def typo_limit(length: int) -> int:
    return 1 if length <= 4 else 3 if length <= 8 else 4
