"""Texts made to break patterns: bounded time, memory and stack for each, and the results that they must have."""

import time

import pytest

from caseloom.llm import host_paths, private_spans, secret_ledger
from caseloom.session import run_dir

MB = 1_000_000
BODY = "<p>" + "The text of the article goes on, and on, for a while here. " * 4 + "</p>"

#: --- fixed values: names that sites give to containers beside the text ---
NOISE = [
    "reader-comments", "user-comments", "comment-body", "comment-thread", "cookie-banner-v2", "newsletter-signup-cta",
    "related-reading", "comment-list", "commentlist", "comments-area", "wp-comments", "disqus-thread", "fb-comments",
    "reply-list", "promo-box-inline", "share-buttons-row", "social-links", "ad-slot-top", "gdpr-modal", "cookie-notice",
    "subscribe-form-inline", "related-posts", "sidebar-right", "sponsored-content", "advert-inline", "newsletter-box",
    "breadcrumb-trail", "pagination-nav", "popup-overlay", "site-masthead",
]
#: --- fixed values: names of containers around a text ---
WRAPPERS = [
    "has-sidebar", "content has-sidebar", "no-sidebar", "layout-with-sidebar", "comments-open", "comments-closed",
    "cookie-recipes", "post-body",
]


def main_text(inner):
    return host_paths.read_at(host_paths.blocks(f"<html><body><nav>menu</nav>{inner}<footer>f</footer></body></html>"), [])


@pytest.mark.parametrize("name", NOISE)
def test_containers_beside_the_text_are_out(name):
    noise = f'<div class="{name}"><p>noise words that are short.</p></div>'
    inside = main_text(f"<article><h1>T</h1>{BODY}{BODY}{noise}</article>")
    after = main_text(f"<article><h1>T</h1>{BODY}{BODY}</article>{noise}")
    loose = main_text(f"<div class=content><h1>T</h1>{BODY}{BODY}</div>{noise}")
    assert inside == after == loose == main_text(f"<article><h1>T</h1>{BODY}{BODY}</article>")


@pytest.mark.parametrize("name", WRAPPERS)
def test_containers_around_the_text_stay(name):
    whole = main_text(f"<article><h1>T</h1>{BODY}{BODY}</article>")
    assert main_text(f'<article><h1>T</h1><div class="{name}">{BODY}{BODY}</div></article>') == whole
    assert main_text(f'<div class="{name}"><article><h1>T</h1>{BODY}{BODY}</article></div>') == whole
    assert main_text(f'<div class="{name}"><h1>T</h1>{BODY}{BODY}</div>') == whole
    assert main_text(f'<article class="{name}"><h1>T</h1>{BODY}{BODY}</article>') == whole


def test_long_comments_do_not_outweigh_the_article():
    thread = '<div class="user-comments">' + "<p>I think so as well, and so do many others here.</p>" * 60 + "</div>"
    assert main_text(f"<article><h1>T</h1>{BODY}</article>{thread}") == main_text(f"<article><h1>T</h1>{BODY}</article>")


PAGES = {
    "unclosed": "<a " * 40_000, "signs": "<" * MB, "marked": "<div class=comments>x" * 50_000,
    "spans": "<span>" * 50_000 + "x", "paragraphs": "<p>" + "<div>" * 50_000 + "<p>a<div>b</div>" * 20_000,
    "items": "<ul>" + "<li>x" * 100_000, "quotes": '<a "' * 100_000, "quoted": '<a "<b" ' * 100_000,
    "word": "a" * 10 * MB, "line": "a b " * 2_500_000, "ends": "<div>" * 50_000 + "</span>" * 50_000 + "</p>x" * 50_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_take_time_by_their_size(name):
    start = time.process_time()
    found = host_paths.blocks(PAGES[name])
    host_paths.scores(found)
    host_paths.read_at(found, [])
    assert time.process_time() - start < 5 + 20 * len(PAGES[name]) / MB


TEXTS = {
    "word": "a" * 10 * MB + " x@y.org", "digits": "1" * 2 * MB, "dotted": "1.2.3." + "0" * 5000 + "1",
    "many dots": "1." * 100_000, "letters": "汉" * 200_000 + " 7", "line of numbers": "12345 " * 20_000,
    "signs": "@" * 200_000, "pluses": "+1 " * 50_000, "long number": "+" + "1 " * 200_000 + "x", "line": "ab c1 " * 20_000,
}


@pytest.mark.parametrize("name", TEXTS)
def test_private_spans_take_time_by_the_size(name):
    field = private_spans.learn([("a@b.org", [(0, 7, "email")]), ("1.2.3.4", [(0, 7, "ip")])])
    start = time.process_time()
    base, spans = private_spans.spans_of(TEXTS[name], field)
    assert time.process_time() - start < 5 + 120 * len(TEXTS[name]) / MB
    assert set(base) <= set(spans)


def test_base_spans_of_hard_texts():
    assert private_spans.base_spans("1.2.3." + "0" * 5000 + "1") == [(0, 5007, "ip")]
    assert private_spans.base_spans("1.2.3." + "9" * 5000) == []
    assert private_spans.base_spans("a@b@c.d x@y z@y.z_q@r.s") == [(2, 7, "email"), (12, 17, "email"), (17, 23, "email")]
    assert private_spans.base_spans("@x.y a@.b a@b.") == []


def test_emails_are_those_of_the_pattern():
    import random

    picked = random.Random(5)
    for _ in range(3000):
        text = "".join(picked.choice("ab@@..-_ 1%") for _ in range(picked.randrange(40)))
        wanted = [(m.start(), m.end(), "email") for m in private_spans.PATTERNS["email"].finditer(text)]
        assert private_spans._emails(text) == wanted


def test_secrets_in_hard_texts(spark):
    pem = "-----BEGIN " + "A " * 50_000 + "PRIVATE KEY-----"
    texts = [
        pem, "-----BEGIN " * 50_000, "eyJ" * 300_000, "eyJ" * 300_000 + "." + "a" * 100_000, "password" * 200_000,
        "token" + " " * MB, "A" * 10 * MB, "0" * 10 * MB, "AKIA" * MB, "xoxb-" * 200_000, "api_key=" + "z" * MB,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ledger = secret_ledger.SecretLedger(spark, run_dir(spark, "ledger"))
    start = time.time()
    found = {r.doc_id: r for r in secret_ledger.secret_digest(ledger.scan(docs)).collect()}
    assert time.time() - start < 120
    assert found[0].spans == f"pem:0:{len(pem)}"
    assert found[7].n_hex == 1 and found[8].n_access == 1 and found[10].n_assign == 1
