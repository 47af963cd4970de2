"""Malformed pages, odd strings for tokenizers, letters beyond ASCII in the string kernel, benchmark items of numbers."""

import random
import time

import numpy as np

from skyloom.llm import token_output as to
from skyloom.llm.common import ship
from skyloom.llm.decontamination import decontaminate, keep_unleaked
from skyloom.llm.html_text import extract, extract_pages
from skyloom.llm.toxicity import Landmarks
from tests.llm.test_scans import docs, plain_kernel


def test_malformed_pages(spark):
    ship(spark)
    text = "words of some length that are what the page is about, "
    bad = ["<p>a</p><![ ]><p>b</p>", "<p>a</p><![foo[ bar ]]><p>b</p>", "<![", "<!", "<!--", "<![CDATA[x", "<a '", "</", "&#", "&#x110000;&#0;&bogus", "<p " * 50, "\x00<\x00p>"]
    rows = [(i, "u", h) for i, h in enumerate([*bad, f"<article><p>{text}</p></article>"])]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[0] == got[1] == "a\nb" and got[len(bad)] == text.strip()
    assert extract(f"<p>{text * 2}</p>") == (text * 2).strip()
    page = f"<article><h1>T</h1><p>{text * 2}</p><div class='note alert'><p>This page is old and will be moved soon, so do not use it.</p></div><p>{text}</p><div class='feedback'><p>I liked this very much and read it twice.</p></div></article>"
    assert extract(page) == f"T\n{(text * 2).strip()}\n{text.strip()}"
    assert extract(f"<article><p>{text}</p><p title='x>{text}</p><p>more {text}</p></article>").startswith(text.strip())


def test_fuzzed_pages():
    rnd = random.Random(3)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<![", "]]>", "<!--", "-->", "--!>", "<!", ">", "<", "</", "<a href='", "'", '"', "<b>", "</b>", "<li>", "<td>", "text ", "&amp;", "&#", "<script>", "</script>", "<option>", "<?x", "\x00", "<h1 ", "/>", "<br/>", "é", "<![CDATA[", "<svg/>", "</html>", "<style>", "<title>"]
    for _ in range(10_000):
        assert isinstance(extract("".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25)))), str)


def test_time_of_unclosed_markup():
    """A long page takes time in proportion: ten times as long, not a hundred."""
    for unit in ("<b><p>x", "<h1></x>", "<!--", "<![ ", "<a ", "<a '>", "<", "<li><b>", "</p>"):
        took = []
        for n in (2_000, 20_000):
            began = time.process_time()
            extract(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 30 * took[0] + 0.5, unit
    began = time.process_time()
    extract("<b>" * 8000 + "<p>" * 8000)
    assert time.process_time() - began < 2


def test_odd_strings_for_tokenizers():
    """Word by word, or whole where a tokenizer fails the probe: the tokenizer's own ids."""
    import public_tokenizers

    rnd = random.Random(5)
    marks = "HTJİΣσ<|, .̱̻́̌̇iaA'S1"
    letters = [chr(c) for c in [*range(0xA0, 0x250), *range(0x300, 0x460), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB07)]]
    for name, n in (("word_bpe_49k.json", 20_000), ("byte_bpe_50k.json", 2_000)):
        e = to.WordEncoder(public_tokenizers.path(name), 1000)
        assert e.by_word == name.startswith("word")
        texts = ["İ, Σ", "", " ", "x" * 100_000]
        for _ in range(n):
            some = rnd.choice([to.ODD_WORDS + to.ODD_SPACES, list(marks), letters, letters + list(marks)])
            texts.append("".join(rnd.choice(some) for _ in range(rnd.randrange(1, 14))))
        for i in range(0, len(texts), 1000):
            for t, got in zip(texts[i : i + 1000], e(texts[i : i + 1000])):
                assert got.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_kernel_beyond_ascii():
    words = ["дурак", "дурaк", "дурдак", "привет", "ηλίθιος", "ηλιθιος", "καλημέρα", "crétin", "cretin", "crétiin", "débile", "idiot", "idiöt", "馬鹿野郎", "馬鹿な野郎", "😀😡😀", "é" * 20]
    k = Landmarks(words)(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert np.isclose(k[i, j], plain_kernel(a, b), atol=1e-4), (a, b)
    assert k[0, 3] < 0.1 < 0.4 < k[0, 2] and k[4, 6] < 0.1


def test_items_of_numbers(spark):
    """Items none of whose windows holds four words: found by their exact words, at any place of a text."""
    items = ["What is 12 + 7 * 3 - 4 / 2 + 9 ?", "Sort 9 4 7 1 8 2 6 3 5 ascending", "5 km 3 h 7 kg 2 l in total", "Add 3 and 4", "Is 17 + 4 * 2 right"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"so then {items[0]} and more", f"{items[1]}", f"3 {items[2].upper()}.", "What is 12 + 7 * 3 - 4 / 2 + 8 ?", items[3], f"we {items[3]} here", f"Tell me: {items[4].lower()}, or not?", "", None]
    got = {r.doc_id: r.item_ids for r in decontaminate(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(9)] == [[0], [1], [2], [], [3], [], [4], [], []]
    d = docs(spark, texts)
    assert sorted(r.doc_id for r in keep_unleaked(d.union(d), bench).collect()) == sorted([3, 5, 7, 8] * 2)
    assert keep_unleaked(d.limit(0), bench).count() == 0 and keep_unleaked(d, bench.limit(0)).count() == 9


def test_random_items_are_found(spark):
    """Whatever an item is made of, a text that holds its words in their order is caught; one that holds other numbers in an order of its own is not."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3))
    kinds = [word, lambda: word().capitalize(), lambda: str(rnd.randrange(10**6)), lambda: f"{rnd.randrange(999)} km", lambda: word().upper(), lambda: rnd.choice("+-*/="), lambda: word() + "."]
    items = []
    for _ in range(60):
        weights = [rnd.random() ** 3 + 0.01 for _ in kinds]
        items.append(" ".join(rnd.choices(kinds, weights)[0]() for _ in range(rnd.randrange(12, 40))))
    items = [x for x in items if sum(any(c.isalnum() for c in w) for w in x.split()) >= 5]  # shorter ones must be the text
    texts, want = [], []
    for i, item in enumerate(items):
        around = [" ".join(word() for _ in range(rnd.randrange(1, 40))) for _ in range(2)]
        texts += [f"{around[0]}. {item} {around[1]}", f"{around[1]} {item.lower()}. {around[0]}", " ".join(around)]
        want += [[i], [i], []]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == want
