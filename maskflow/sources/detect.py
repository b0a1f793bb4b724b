"""Detectors: from text to evidence, an array of spans with provider and score on each row."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EVIDENCE, is_blank, luhn, match_spans, once
from ..plans.model import MAX_SPANS, ConfigError, RegexRule, RemoteConfig, provider_id

#: Validators by id: from a candidate column to a boolean.
VALIDATORS: dict[str, Callable[[Column], Column]] = {"luhn": luhn}
FAILURE = "struct<provider:string,code:string,phase:string,attempt_count:int>"
NO_EVIDENCE = f"array<{EVIDENCE}>"


class Detector(Protocol):
    """Gives a row's evidence and its failure (null if none) as columns.

    ``provider`` is its canonical id (CUSTOM if it has no name of its own), ``own_types`` are trusted for its own
    evidence only."""

    provider: str
    own_types: tuple[str, ...]

    def detect(self, df: DataFrame, text: str, out: str, when: Column | None = None) -> DataFrame:
        """Adds ``out``: struct<evidence, failure>; rows where ``when`` is false are left alone (null)."""


def _outcome(evidence: Column, failure: Column | None = None) -> Column:
    failure = F.lit(None).cast(FAILURE) if failure is None else failure
    whole = F.when(failure.isNull(), evidence).otherwise(F.array().cast(NO_EVIDENCE))
    return F.struct(whole.cast(NO_EVIDENCE).alias("evidence"), failure.alias("failure"))


def failure_of(provider: str, code: str, attempts: int = 1) -> Column:
    return F.struct(F.lit(provider).alias("provider"), F.lit(code).alias("code"), F.lit("ANALYSIS").alias("phase"), F.lit(attempts).alias("attempt_count"))


class RegexDetector:
    """Rules in order, all matches of each; spans of different rules may overlap.

    Whole matches are found by built-in expressions. No built-in gives the offsets of a capture group, so a rule with one
    looks for it within the matches in an Arrow-batched function, in Python's dialect: where that finds other matches
    than the built-in one, or the group takes no part or is empty, the row fails.
    """

    def __init__(self, rules: Iterable[RegexRule], provider: str = "REGEX", validators: Mapping[str, Callable[[Column], Column]] | None = None):
        self.rules, self.provider = tuple(rules), provider_id(provider)
        self.validators = {**VALIDATORS, **(validators or {})}
        self.own_types = tuple(sorted({r.entity_type for r in self.rules}))
        if unknown := {r.validator_id for r in self.rules if r.validator_id} - set(self.validators):
            raise ConfigError(f"unknown validators: {sorted(unknown)}")

    def detect(self, df: DataFrame, text: str, out: str, when: Column | None = None) -> DataFrame:
        value = F.col(text)
        parts, bad = [], F.lit(False)
        for k, rule in enumerate(self.rules):
            if rule.capture_group:
                whole = F.when(value.rlike(rule.pattern), F.regexp_extract_all(value, F.lit(rule.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
                df = df.withColumn(f"_group_{k}", group_spans(rule.pattern, rule.capture_group)(value, whole))
                found = F.col(f"_group_{k}")
                bad = bad | (~is_blank(value) & found.isNull())
                found = F.coalesce(found, F.array().cast("array<struct<start:int,end:int,value:string>>"))
            else:
                found = match_spans(value, rule.pattern)  # an empty match breaks the range contract and fails there
            if rule.validator_id:
                found = F.filter(found, self._checked(rule.validator_id))
            parts.append(F.transform(found, self._typed(rule)))
        evidence = F.concat(*parts) if parts else F.array().cast(NO_EVIDENCE)
        evidence = F.when(is_blank(value), F.array().cast(NO_EVIDENCE)).otherwise(evidence)
        failure = F.when(bad, failure_of(self.provider, "ANALYZER_CONTRACT_VIOLATION"))
        result = _outcome(evidence, failure)
        return once(df, **{out: result if when is None else F.when(when, result)}).drop(*(f"_group_{k}" for k in range(len(self.rules))))

    def _checked(self, validator: str) -> Callable[[Column], Column]:
        check = self.validators[validator]
        return lambda x: check(x["value"])

    def _typed(self, rule: RegexRule) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(self.provider).alias("provider"), F.lit(rule.entity_type).alias("entity_type"), F.lit(float(rule.score)).alias("score"))


def group_spans(pattern: str, group: int):
    """D3: pandas function from text and the whole matches that the engine's own dialect finds to the spans of one group;
    null where a match breaks the contract, or Python's dialect finds other matches."""

    @F.pandas_udf("array<struct<start:int,end:int,value:string>>")
    def find(texts: pd.Series, wholes: pd.Series) -> pd.Series:
        try:
            compiled = re.compile(pattern)
        except re.error:
            compiled = None

        def one(t, whole):
            if not t or not len(whole):
                return []
            found = list(compiled.finditer(t)) if compiled else []
            spans = [m.span(group) for m in found]
            if [m[0] for m in found] != list(whole) or any(a < 0 or a == b for a, b in spans):
                return None
            return [{"start": a, "end": b, "value": t[a:b]} for a, b in spans]

        return pd.Series([one(t, w if w is not None else []) for t, w in zip(texts, wholes, strict=True)], dtype="object")

    return find


class SuppliedDetector:
    """Evidence that the caller has in a column already."""

    own_types: tuple[str, ...] = ()

    def __init__(self, column: str, provider: str = "EXTERNAL"):
        self.column, self.provider = column, provider_id(provider)

    def detect(self, df: DataFrame, text: str, out: str, when: Column | None = None) -> DataFrame:
        mine = F.transform(F.coalesce(F.col(self.column), F.array()), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(self.provider).alias("provider"), x["entity_type"].alias("entity_type"), x["score"].alias("score")))
        result = _outcome(F.when(is_blank(F.col(text)), F.array().cast(NO_EVIDENCE)).otherwise(mine))
        return once(df, **{out: result if when is None else F.when(when, result)})


class FunctionDetector:
    """Any Python detector, run on Arrow batches.

    ``make()`` is called once for each batch of rows and gives ``analyze(text) -> [(type, start, end, score)]``;
    what it raises becomes a failure, never a text. AnalyzerFailed says which."""

    own_types: tuple[str, ...] = ()

    def __init__(self, make: Callable[[], Callable[[str], list]], provider: str = "CUSTOM", own_types: Iterable[str] = ()):
        self.make, self.provider, self.own_types = make, provider_id(provider), tuple(own_types)

    def detect(self, df: DataFrame, text: str, out: str, when: Column | None = None) -> DataFrame:
        make, provider = self.make, self.provider

        @F.pandas_udf(f"struct<evidence:{NO_EVIDENCE},failure:{FAILURE}>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            analyze = make()
            for texts in batches:
                rows = [_analyzed(analyze, provider, t) for t in texts]
                yield pd.DataFrame({"evidence": [e for e, _ in rows], "failure": [f for _, f in rows]})

        value = F.col(text)
        run_on = ~is_blank(value) if when is None else when & ~is_blank(value)
        found = F.when(run_on, run(F.when(run_on, value)))
        blank = _outcome(F.array().cast(NO_EVIDENCE))
        result = F.coalesce(found, F.when(is_blank(value), blank))
        return once(df, **{out: result if when is None else F.when(when, result)})


class AnalyzerFailed(Exception):
    """E5: a detector's failure, with its code and the attempts made."""

    def __init__(self, code: str = "ANALYZER_EXECUTION_FAILED", attempts: int = 1):
        super().__init__(code)
        self.code, self.attempts = code, max(1, attempts)


def _analyzed(analyze, provider: str, text: str | None) -> tuple[list[dict], dict | None]:
    if text is None:
        return [], None
    try:
        spans = analyze(text)
        if spans is None or len(spans) > MAX_SPANS:
            raise AnalyzerFailed("ANALYZER_CONTRACT_VIOLATION")
        rows = []
        for kind, start, end, score in spans:
            if not (isinstance(start, int) and isinstance(end, int) and 0 <= start < end <= len(text) and 0.0 <= score <= 1.0):
                raise AnalyzerFailed("ANALYZER_CONTRACT_VIOLATION")
            rows.append({"start": start, "end": end, "provider": provider, "entity_type": kind, "score": float(score)})
        return rows, None
    except AnalyzerFailed as e:
        return [], {"provider": provider, "code": e.code, "phase": "ANALYSIS", "attempt_count": e.attempts}
    except InterruptedError:  # E8: the detector gave up because it was told to stop
        return [], {"provider": provider, "code": "ANALYSIS_INTERRUPTED", "phase": "ANALYSIS", "attempt_count": 1}
    except Exception:  # E6: what a detector raises may hold text, so only the code goes on
        return [], {"provider": provider, "code": "ANALYZER_EXECUTION_FAILED", "phase": "ANALYSIS", "attempt_count": 1}


# --- remote detectors ------------------------------------------------------------------------------------------


def http_failure(status: int) -> tuple[str, bool]:
    """Failure code of an HTTP status, and whether another attempt makes sense."""
    if status in (401, 403):
        return "ANALYZER_AUTHENTICATION_FAILED", False
    if status == 408:
        return "ANALYZER_TIMEOUT", True
    if status == 429:
        return "ANALYZER_RATE_LIMITED", True
    if status >= 500:
        return "ANALYZER_UNAVAILABLE", True
    return "ANALYZER_EXECUTION_FAILED", False


def http_failure_column(status: Column) -> tuple[Column, Column]:
    """The same, as columns."""
    code = (
        F.when(status.isin(401, 403), "ANALYZER_AUTHENTICATION_FAILED").when(status == 408, "ANALYZER_TIMEOUT").when(status == 429, "ANALYZER_RATE_LIMITED").when(status >= 500, "ANALYZER_UNAVAILABLE").otherwise("ANALYZER_EXECUTION_FAILED")
    )
    return code, status.isin(408, 429) | (status >= 500)


def parse_remote(body: bytes) -> list[tuple[str, int, int, float]]:
    """An array of objects that have entity_type, start, end and score exactly once each."""

    def once(pairs):
        names = [k for k, _ in pairs]
        if len(set(names)) < len(names) or any(len(k) > 256 for k in names):
            raise AnalyzerFailed("ANALYZER_RESPONSE_INVALID")
        return dict(pairs)

    try:
        if depth_of(body) > 64:
            raise AnalyzerFailed("ANALYZER_RESPONSE_INVALID")
        rows = json.loads(body.decode("utf-8"), object_pairs_hook=once)
        out = []
        for row in rows if isinstance(rows, list) else [None]:
            kind, start, end, score = row["entity_type"], row["start"], row["end"], row["score"]
            numbers = all(isinstance(x, int) and not isinstance(x, bool) for x in (start, end)) and isinstance(score, (int, float)) and not isinstance(score, bool)
            if not (isinstance(kind, str) and numbers):
                raise AnalyzerFailed("ANALYZER_RESPONSE_INVALID")
            out.append((kind, start, end, float(score)))
        return out
    except AnalyzerFailed:
        raise
    except (ValueError, KeyError, TypeError, RecursionError):
        raise AnalyzerFailed("ANALYZER_RESPONSE_INVALID") from None


def depth_of(body: bytes) -> int:
    """How deep the arrays and objects of a JSON text are nested."""
    depth = most = 0
    for m in re.finditer(rb'"(?:\\.|[^"\\])*"|[\[{]|[\]}]', body):
        if m[0] in b"[{":
            depth += 1
            most = max(most, depth)
        elif m[0] in b"]}":
            depth -= 1
    return most


def remote_analyzer(config: RemoteConfig, language: str = "en", send=None, sleep=time.sleep):
    """``make`` for a FunctionDetector. ``send(url, body, headers, timeout) -> (status, body)``; the default is
    urllib, one client for each batch of rows. Retries happen here, so that a task is not run again for them."""

    def make():
        ask = send or partial(_urllib_send, most=config.max_response_bytes)

        def analyze(text: str):
            body = json.dumps({"text": text, "language": language}).encode()
            for attempt in range(1, config.retries + 2):
                try:
                    status, answer = ask(config.url.rstrip("/") + "/analyze", body, {**config.headers, "Content-Type": "application/json"}, config.timeout_s)
                    if status // 100 == 2:
                        if len(answer) > config.max_response_bytes:
                            raise AnalyzerFailed("ANALYZER_RESPONSE_INVALID", attempt)
                        try:
                            return parse_remote(answer)
                        except AnalyzerFailed as e:
                            raise AnalyzerFailed(e.code, attempt) from None
                    code, again = http_failure(status)
                except TimeoutError:
                    code, again = "ANALYZER_TIMEOUT", True
                except InterruptedError:
                    raise
                except OSError:
                    code, again = "ANALYZER_UNAVAILABLE", True
                if not again or attempt > config.retries:
                    raise AnalyzerFailed(code, attempt)
                sleep(config.backoff_s)
            raise AnalyzerFailed()

        return analyze

    return make


def _urllib_send(url: str, body: bytes, headers: Mapping[str, str], timeout: float, most: int = 8 << 20) -> tuple[int, bytes]:
    """Reads one byte more than ``most``, so that the caller can tell a body that is too long."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, body, dict(headers), method="POST"), timeout=timeout) as answer:
            return answer.status, answer.read(most + 1)
    except HTTPError as e:
        return e.code, b""


def preflight(config: RemoteConfig, ask) -> dict:
    """Health of a remote detector, by one call of ``ask(url, timeout) -> status``."""
    try:
        status = ask(config.url.rstrip("/") + "/health", config.timeout_s)
    except TimeoutError:
        return {"status": "DOWN", "code": "ANALYZER_TIMEOUT"}
    except OSError:
        return {"status": "DOWN", "code": "ANALYZER_UNAVAILABLE"}
    return {"status": "UP"} if status // 100 == 2 else {"status": "DOWN", "code": http_failure(status)[0]}


# --- named entities --------------------------------------------------------------------------------------------


def ner_analyzer(models: Mapping[str, Callable[[list[str]], list[tuple[int, int, float]]]], language: str, configured: str, tokens: str = r"\w+|[^\w\s]"):
    """``make`` for a FunctionDetector around name finders, one for each type, that map words to word ranges."""

    def make():
        words_of = re.compile(tokens)

        def analyze(text: str):
            if language != configured:
                raise AnalyzerFailed("ANALYZER_EXECUTION_FAILED")
            words = list(words_of.finditer(text))
            out = []
            for kind, find in models.items():
                for a, b, p in find([w[0] for w in words]):
                    if not 0 <= a < b <= len(words):
                        raise AnalyzerFailed("ANALYZER_CONTRACT_VIOLATION")
                    out.append((kind, words[a].start(), words[b - 1].end(), p))
            return out

        return analyze

    return make


class GazetteerDetector:
    """D14 without a model: words of a list (checked to be small) are spans of their type; all built-in expressions."""

    MOST = 10_000

    def __init__(self, names: Mapping[str, str], score: float = 0.9, provider: str = "GAZETTEER"):
        if not names or len(names) > self.MOST or any(not re.fullmatch(r"\w+", n) for n in names):
            raise ConfigError("a gazetteer holds single words, and at most 10,000")
        self.names, self.score, self.provider, self.own_types = dict(names), score, provider_id(provider), tuple(sorted(set(names.values())))

    def detect(self, df: DataFrame, text: str, out: str, when: Column | None = None) -> DataFrame:
        words = match_spans(F.col(text), "[A-Za-z0-9_]+")
        kinds = F.create_map(*(F.lit(x) for pair in sorted(self.names.items()) for x in pair))
        typed = F.filter(F.transform(words, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lit(self.provider).alias("provider"), F.element_at(kinds, w["value"]).alias("entity_type"), F.lit(float(self.score)).alias("score"))), lambda x: x["entity_type"].isNotNull())
        result = _outcome(F.when(is_blank(F.col(text)), F.array().cast(NO_EVIDENCE)).otherwise(typed))
        return once(df, **{out: result if when is None else F.when(when, result)})


def read_corpus(spark, path: str) -> DataFrame:
    """V2: id, expected_types, expected_values, text of a tab-separated corpus; '#' begins a comment, '-' is an empty list."""
    cells = F.split("value", "\t", -1)
    many = lambda c: F.when(c == "-", F.array().cast("array<string>")).otherwise(F.split(c, ",", -1))
    lines = spark.read.text(path).where("value <> '' and value not like '#%'")
    return lines.select(cells[0].alias("id"), many(cells[1]).alias("expected_types"), many(cells[2]).alias("expected_values"), cells[3].alias("text"))
