import random
import re

from feedloom import SiteProfile
from feedloom.functions import fixed, text
from feedloom.functions.entities import extract_entities, site_lexicon

SITE = SiteProfile("https://feed.example", "feed.example", "Feed Example")


def _apply(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    return [r.c for r in rows.select("i", column.alias("c")).orderBy("i").collect()]


def _expected_clean(raw, patterns=fixed.NOISE):
    """Plain loop with Python's own regular expressions."""
    for p in patterns:
        raw = re.sub(p, "", raw, flags=re.I | re.M)
    kept = []
    for line in re.sub(r"[ \t]+", " ", raw).splitlines():
        line = line.strip()
        if line or (kept and kept[-1]):
            kept.append(line)
    return "\n".join(kept).strip()


def _expected_clean_v1(raw):
    for p in fixed.NOISE_V1:
        raw = re.sub(p, "", raw, flags=re.I)
    return re.sub(r"\n\s*\n", "\n\n", raw).strip()


PIECES = [
    "Sources", "14 sources", "1 source", "+123", "42", "Ask follow-up", "ask followup", "Copy", "Copy link", "Share",
    "model", "Model", "View", "more", "View more", "Read more", "Discover more", "Back to Discover", "Explore Discover",
    "Search for anything", "Ask anything...", "Ask anything...now", "Published on Mar 3", "Ad", "Baghdad", "Ads",
    "Related stories", "View original", "ReSources", "Shareholders", "ſources", "Sharé", "vıew more", "dİscover more",
    "text", "niño", "多言語", "é", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0",
    " ", "　", ".", ",", "-", "_", "́", "٣",
]


def test_clean_noise_equals_plain_loop(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    got = _apply(spark, texts, text.clean_noise("text"))
    assert [(t, g) for t, g in zip(texts, got) if g != _expected_clean(t)] == []
    got = _apply(spark, texts, text.clean_noise_v1("text"))
    assert [(t, g) for t, g in zip(texts, got) if g != _expected_clean_v1(t)] == []


def test_clean_noise_known_texts(spark):
    block = """
    Sources
    Ask follow-up
    14 sources
    Related stories
    This is the real content.
    View more
    Share
    Model
    Back to Discover
    +123
    """
    cases = {
        block: "This is the real content.",
        "Baghdad": "Baghd",
        "the language model works": "the language works",
        "Ask anything...": "Ask anything...",
        "Ask anything...now": "now",
        "Published on Mar 3\nX": "X",
        "a\n\n\n\nb": "a\n\nb",
        None: "",
        "": "",
    }
    assert dict(zip(cases, _apply(spark, list(cases), text.clean_noise("text")))) == cases
    assert _apply(spark, ["Baghdad\nBig Ad"], text.clean_noise("text", word_safe=True)) == ["Baghdad\nBig"]


def test_long_blank_runs_do_not_overflow(spark):
    long = "a" + "\n \t\xa0" * 1500 + "b" + " 7\n" * 1500
    assert _apply(spark, [long], text.clean_noise("text")) == [_expected_clean(long)]


def test_entities(spark):
    lexicon = site_lexicon(SITE)
    texts = ["Python, AI and feed; GOOGLE's gpu_x gpu", "éai ai2 _ai", "", None]
    got = _apply(spark, texts, extract_entities("text", {k: v for k, v in lexicon.items()}))
    assert [tuple(map(list, g)) for g in got] == [
        (["python", "ai"], ["google"], ["gpu"]), ([], [], []), ([], [], []), ([], [], [])
    ]
    phrases = {"things": ("feed example", "c[+]+", "api")}
    (found,) = _apply(spark, ["Our Feed Example api"], extract_entities("text", phrases))
    assert found.things == ["feed example", "api"]
    assert lexicon["companies"][1] == "feed example"


def test_md_escape(spark):
    assert _apply(spark, [" [a]\nb ", None], text.md_escape("text")) == ["(a) b", ""]
