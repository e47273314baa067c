"""Text, token and routing expressions against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from caseloom import fixed_values as v
from caseloom.functions import links, text
from caseloom.functions.messages import arrived, command_argument, intent, topic
from caseloom.streaming.messages import routed


def column(spark, values, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


SPACES = ["", "      ", " a b ", " x ", "\x1cy\x85", "\ttab\nline\r\n", "e-mail", "Écran cassé"]


def test_strip_words_and_blank_are_pythons(spark):
    assert column(spark, SPACES, text.strip) == [s.strip() for s in SPACES]
    assert column(spark, SPACES, text.words) == [s.split() for s in SPACES]
    assert column(spark, SPACES, text.non_blank) == [bool(s.strip()) for s in SPACES]
    assert column(spark, [None], text.non_blank) == [False]


def test_clean_text(spark):
    got = column(spark, ["The E-mail, is DOWN!", "café 42", "", None], lambda x: text.clean_text(x, ["the", "is"]))
    assert got == ["email down", "caf 42", "", ""]


def test_tokens_and_grams(spark):
    got = column(spark, ["Écran a cassé_2 x!", "one", "", "a b"], text.tokens)
    assert got == [["écran", "cassé_2"], ["one"], [], []]
    df = spark.createDataFrame([("vpn is down now",), ("vpn",), ("",)], "x string")
    terms = [r["terms"] for r in text.with_terms(df, "x", ["is"]).collect()]
    assert terms == [["vpn", "down", "now", "vpn down", "down now"], ["vpn"], []]


def test_combined_text(spark):
    row = spark.createDataFrame(
        [(" s ", None, "Incident", "Open", "me")],
        "summary string, latest_comments string, task_type string, status string, ticket_owner string",
    )
    plain, owned = row.select(text.combined_text().alias("a"), text.combined_text(True).alias("b")).first()
    assert plain == "s   Task Type: Incident Status: Open"
    assert owned == "s   Task Type: Incident Status: Open Owner: me"


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_rounds_like_python(spark, digits):
    numbers = [0.25, 0.125, 0.285, 2.5, 24962.35, -0.75, 1e-9, 123456.789, 0.0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").coalesce(1)
    got = [r[0] for r in df.select(text.fixed(F.col("x"), digits)).collect()]
    wanted = [f"{x:.{digits}f}" for x in numbers]
    assert [g.replace("-0", "0") if float(g) == 0 else g for g in got] == wanted


def test_reflow_hits_every_occurrence(spark):
    answer = "1. a 2. b 21. c 0.1. d 7. e"
    wanted = answer
    for i in range(1, 7):
        wanted = wanted.replace(f"{i}.", f"\n{i}.")
    assert column(spark, [answer], text.reflow_numbered) == [wanted]


def test_preview_and_defaults(spark):
    assert column(spark, ["x" * 100, "x" * 101], text.preview) == ["x" * 100, "x" * 100 + "..."]
    assert column(spark, ["", None, "y"], lambda c: text.or_default(c, "N/A")) == ["N/A", "N/A", "y"]


SAMPLES = {
    "Are there any similar tickets to VPN issues?": ("similar", "vpn issues?"),
    "Find tickets related to network problems": ("similar", "network problems"),
    "Show me similar incidents about email issues": ("similar", "incidents email issues"),
    "What tickets are like password reset problems?": ("chat", None),
    "Can you recommend solutions for printer issues?": ("recommend", "printer issues?"),
    "How to fix database connection errors?": ("recommend", "fix database connection"),
    "the prefix is unrelated": ("recommend", "unrelated"),
    "unrelated": ("similar", "unrelated"),
    "/similar  VPN down ": ("similar_command", "vpn down"),
    "/SIMILAR": ("similar_command", None),
    "/recommend anything": ("recommend_command", "High priority tickets"),
    "/help": ("help_command", None),
    "/unknown fix": ("ignored", None),
    " /similar x": ("similar", "/similar"),
    "  \n ": ("empty", None),
    "suggest": ("recommend", "suggest"),
    "hello": ("chat", None),
}


def test_routing_samples(spark):
    df = spark.createDataFrame([(m,) for m in SAMPLES], "text string").coalesce(1)
    got = {r["text"]: (r["intent"], r["search_text"]) for r in routed(df).collect()}
    assert got == SAMPLES
    offline = routed(spark.createDataFrame([("Hello",)], "text string"), model_available=False).first()
    assert (offline["intent"], offline["search_text"]) == ("fallback_similar", "hello")
    assert routed(spark.createDataFrame([(None,)], "text string")).first()["intent"] == "empty"


def plain_topic(said, keywords):
    def telling(part):
        return [w for w in part.split() if len(w) > 2 and w not in v.TOPIC_STOP_WORDS]

    tails = [said.split(k, 1)[1] for k in keywords if k in said] + [said]
    found = next((telling(t) for t in tails if telling(t)), None)
    return " ".join(found[:3]) if found else said


def test_topics_equal_plain_python(spark):
    pick = random.Random(3)
    bits = [*v.RECOMMEND_KEYWORDS, *v.SIMILAR_KEYWORDS, *v.TOPIC_STOP_WORDS, "vpn", "no", "printer", "écran", "x"]
    said = [" ".join(pick.choices(bits, k=pick.randint(0, 7))) for _ in range(400)]
    for keywords in (v.RECOMMEND_KEYWORDS, v.SIMILAR_KEYWORDS):
        got = column(spark, said, lambda x: topic(arrived(x), keywords))
        assert got == [plain_topic(s, keywords) for s in said]


def test_command_argument(spark):
    assert column(spark, ["/similar  a b ", "/similar", "/similarity"], command_argument) == ["a b", "", "ity"]


def readable(token):
    try:
        int(token, 16)
    except ValueError:
        return False
    return len(token) == 32


def test_token_format_is_pythons(spark):
    pick = random.Random(5)
    tokens = ["".join(pick.choices("0123456789abcdefABCDEFx_+- g", k=32)) for _ in range(300)]
    tokens += ["a" * 32, "a" * 31, "0x" + "a" * 30, "0X_" + "a" * 29, "a_" * 16, "_" + "a" * 31, "+" + "F" * 31]
    tokens += [" " + "a" * 30 + "\n", "a" * 15 + "__" + "a" * 15, "123", "abcdefg", "not-a-valid-token", ""]
    assert column(spark, tokens, links.looks_like_token) == [readable(t) for t in tokens]
    assert column(spark, [None], links.looks_like_token) == [False]


def test_tokens_and_links(spark):
    numbers = ["12345", "TICKET-001", "INC-789"]
    wanted = [hashlib.sha256(f"{n}-100-secret".encode()).hexdigest()[:32] for n in numbers]
    token = lambda x: links.access_token(x, F.lit(100), "secret")
    assert column(spark, numbers, token) == wanted
    assert column(spark, numbers, lambda x: links.looks_like_token(token(x))) == [True] * 3
    got = column(spark, numbers, lambda x: links.ticket_link("https://h", x, token(x)))
    assert got == [f"https://h/direct-ticket/{n}/{t}" for n, t in zip(numbers, wanted)]
    for now, ok in ((100, True), (86500, True), (86501, False), (99, False)):
        valid = lambda x: links.is_valid_token(token(x), x, F.lit(100), F.lit(now), "secret")
        assert column(spark, numbers, valid) == [ok] * 3
    other = lambda x: links.is_valid_token(token(x), F.lit("other"), F.lit(100), F.lit(100), "secret")
    assert column(spark, numbers, other) == [False] * 3
    with pytest.raises(ValueError):
        links.access_token(F.lit("1"), F.lit(1), "")


def test_intent_is_a_column_of_one_text(spark):
    assert column(spark, ["Resolution of X"], lambda x: intent(arrived(x))) == ["recommend"]
