"""Configuration: C1, C2, C4-C6, D5, D13, F5, G1-G4, P4, P17, P19."""

import pytest

from maskflow.operators.policy import bundle
from maskflow.plans import model as m
from maskflow.sources.detect import RegexDetector, depth_of, http_failure, parse_remote, preflight, AnalyzerFailed


def refuses(f, *args, **kw):
    with pytest.raises(m.ConfigError):
        f(*args, **kw)


def test_names():
    assert m.entity_type("EMAIL_ADDRESS") == "EMAIL_ADDRESS"
    for bad in ("", "email", "A__B", "_A", "A_", "A-B", "A" * 129, "Ä"):
        refuses(m.entity_type, bad)
    assert m.provider_id("my-regex_1") == "MY-REGEX_1" and m.language_code("EN-us") == "en-us"
    for bad in ("", "a--b", "-a", "a b", "a" * 129):
        refuses(m.provider_id, bad)
    refuses(m.language_code, "e" * 65)


def test_registry():
    r = m.Registry({"STAFF_NAME": "NAME", "NAME": "PERSON"})
    assert r.resolve("STAFF_NAME") == "PERSON" and r.resolve("STRANGE") == "PII" and r.resolve("STRANGE", ["STRANGE"]) == "STRANGE"
    refuses(m.Registry, {"A": "B", "B": "A"})
    refuses(r.require_trusted, "STRANGE")
    refuses(m.Options(included=("NAME", "PERSON")).allowed, r)
    refuses(m.Options, minimum_score=1.5)


@pytest.mark.parametrize(
    "settings",
    [
        {"mode": "PRIMARY"}, {"failures": "REQUIRE_PRIMARY"}, {"mode": "ODD"}, {"primary": "a", "supplemental": ("A",)}, {"supplemental": ("a", "A")}, {"floors": {"a": 2.0}},
        {"floors": {"a": 0.1, "A": 0.2}}, {"mode": "PRIMARY_WITH_FALLBACK", "primary": "a"}, {"fallback_type": "odd"},
    ],
)
def test_policies_that_contradict_themselves(settings):
    refuses(m.Policy, **settings)


def test_policies_and_providers():
    refuses(m.Policy().check, [])
    refuses(m.Policy().check, ["a", "A"])
    refuses(m.Policy(floors={"x": 0.1}).check, ["a"])
    refuses(m.Policy("PRIMARY", "a").check, ["a", "b"])
    assert m.Policy("PRIMARY", "a", ("b",)).check(["a", "b"]) == ("A", "B")
    fallback = m.Policy("PRIMARY_WITH_FALLBACK", "a", ("s",), "ALLOW_PARTIAL")
    refuses(fallback.check, ["a"])
    assert fallback.stages(["a", "s", "b"]) == (("A", "S"), ("B",))


def test_rules():
    refuses(m.RegexRule, "A", "(x)", capture_group=2)
    refuses(m.RegexRule, "A", r"\(x[(]", capture_group=1)
    assert m.RegexRule("A", r"(?:a)(b)(?<n>c)", capture_group=2)
    refuses(m.RegexRule, "A", " ")
    refuses(m.RegexRule, "A", "x", 1.1)
    refuses(m.RegexRule, "A", "x", validator_id="Bad--id")
    refuses(RegexDetector, [m.RegexRule("A", "x", validator_id="nobody")])
    assert "secret" not in repr(m.RegexRule("A", "secret"))


def test_remote_settings():
    for bad in ("ftp://x", "http://", "http://u:p@x", "http://x?q", "http://x#f"):
        refuses(m.RemoteConfig, bad)
    refuses(m.RemoteConfig, headers={"content-TYPE": "x"})
    refuses(m.RemoteConfig, headers={"A": "1", "a": "2"})
    refuses(m.RemoteConfig, headers={"A b": "1"})
    refuses(m.RemoteConfig, headers={"A": "1\r\n"})
    assert m.RemoteConfig("https://x/y").retries == 1


def test_settings_and_typos():
    c = m.EngineConfig.from_dict({"options": {"language": "DE", "minimum-score": 0.4}, "policy": {"mode": "UNION"}, "rules": [{"entity-type": "A", "pattern": "x"}], "disclosures": {"mail": ["EMAIL_ADDRESS"]}})
    assert c.options.language == "de" and c.rules[0].score == 0.85 and c.disclosures.rows() == [("mail", "EMAIL_ADDRESS")] and c.limits.max_frames == 1024
    with pytest.raises(m.ConfigError, match="did you mean 'minimum-score'"):
        m.EngineConfig.from_dict({"options": {"minimum-scores": 1}, "rules": []})
    refuses(m.EngineConfig)
    refuses(m.EngineConfig, rules=(m.RegexRule("A", "x", validator_id="v"),))
    assert m.closest_key("mdoe", ["mode", "node"]) is None and m.closest_key("langauge", ["language"]) == "language" and m.closest_key("xyz", ["mode"]) is None
    assert m.edit_distance("kitten", "sitting") == 3
    for bad in ({"": {"A"}}, {"*": {"A"}}, {"t": set()}):
        refuses(m.Disclosures, bad)
    refuses(bundle, input_guard=True, model_guard=True, lifecycle=2)
    refuses(bundle, input_guard=True, model_guard=True, lifecycle=1, limits=[m.InspectionLimits(), m.InspectionLimits(5)])


def test_remote_contract():
    assert parse_remote(b'[{"entity_type":"A","start":0,"end":2,"score":0.5,"more":[1]}]') == [("A", 0, 2, 0.5)]
    for bad in (b"{}", b"[1]", b'[{"entity_type":"A","start":0,"end":2}]', b'[{"entity_type":"A","start":0,"start":1,"end":2,"score":1}]', b'[{"entity_type":"A","start":0.5,"end":2,"score":1}]', b"[" * 65 + b"]" * 65, b"\xff"):
        with pytest.raises(AnalyzerFailed, match="ANALYZER_RESPONSE_INVALID"):
            parse_remote(bad)
    assert depth_of(b'[{"a":"]]["}]') == 2
    assert http_failure(429) == ("ANALYZER_RATE_LIMITED", True) and http_failure(404) == ("ANALYZER_EXECUTION_FAILED", False)

    def slow(*_):
        raise TimeoutError

    c = m.RemoteConfig()
    assert preflight(c, lambda *_: 204) == {"status": "UP"} and preflight(c, lambda *_: 503)["code"] == "ANALYZER_UNAVAILABLE" and preflight(c, slow)["code"] == "ANALYZER_TIMEOUT"
