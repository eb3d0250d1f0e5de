"""What needs no session: solvers, scanners, tokenizers, records."""

import base64
import gzip
import io
import json
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillstone.llm import fingerprint, html_extract, packing, quality, secret_scan, sentence_pieces, simhash_neardup, warc


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
@settings(max_examples=40, deadline=None)
def test_every_piece_is_packed_once(pieces):
    lengths, counts = np.unique(pieces, return_counts=True)
    plan = packing.solve(lengths, counts, size=64)
    got = np.zeros(len(lengths), int)
    for pattern, times in plan:
        assert sum(int(lengths[k]) * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            got[k] += n * times
    assert (got == counts).all()
    table = packing.slots(plan, lengths)
    assert len(np.unique(table[:, :2], axis=0)) == len(table)


def test_pricing_finds_the_best_pattern():
    lengths = np.array([3, 5, 7])
    values = np.array([3.0, 5.5, 7.1])
    cost, pattern = packing.price(values, lengths, 16)
    fills = [(a, b, c) for a in range(6) for b in range(4) for c in range(3) if 0 < 3 * a + 5 * b + 7 * c <= 16]
    spent = lambda f: f if f & (f - 1) == 0 else 16
    best = min(spent(3 * a + 5 * b + 7 * c) - (3 * a + 5.5 * b + 7.1 * c) for a, b, c in fills)
    assert cost == pytest.approx(best)
    assert sum(lengths[k] * n for k, n in pattern.items()) <= 16


def _every_pattern(lengths, size):
    found = [()]
    for x in lengths:
        found = [(*p, n) for p in found for n in range(size // x + 1)]
    return np.array([p for p in found if 0 < np.dot(p, lengths) <= size])


@given(st.lists(st.integers(3, 16), min_size=1, max_size=60))
@settings(max_examples=25, deadline=None)
def test_column_generation_reaches_the_linear_optimum(pieces):
    lengths, counts = np.unique(pieces, return_counts=True)
    program = packing.LinearProgram(lengths, counts, 16)
    while program.improve():
        pass
    patterns = _every_pattern(lengths.tolist(), 16)
    fills = patterns @ lengths
    costs = np.where(fills & (fills - 1) == 0, fills, 16)
    # No pattern at all has a reduced cost below zero, and the plan covers the demand: optimal.
    assert (costs - patterns @ program.duals).min() > -1e-4
    assert np.allclose(program.basis.T @ program.amounts, program.demand) and program.cost == pytest.approx(program.bound, rel=1e-4)
    plan = packing.solve(lengths, counts, size=16)
    assert packing.padding(plan, lengths, 16) <= packing.padding(packing._best_fit(lengths, counts, 16), lengths, 16)


def test_column_generation_packs_what_best_fit_does_not():
    lengths, counts = np.array([150, 200, 255, 340, 380, 410]), np.array([60, 61, 62, 63, 64, 65])
    plan = packing.solve(lengths, counts)
    assert packing.padding(plan, lengths) < packing.padding(packing._best_fit(lengths, counts, 1024), lengths)
    program = packing.LinearProgram(lengths, counts)
    start = program.cost
    while program.improve():
        pass
    assert program.rounds > 1 and program.cost < start


ODD = ["", "a  b", "  a", "a   b ", "x \n y", "a\n b", "a\n\n b", " a", "a ", "it's 'll  don't", "<|endoftext|> a b", "a\r\n b", "x y 　z", "\n b", "a\n\n\n b c\t d", "a" * 3000, "é ☃ 漢字 かな a", "a \n\n b"]


def test_word_cache_gives_the_tokenizers_ids():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.public_byte_bpe()
    random.seed(3)
    made = ["".join(random.choices("ab é.,'\n\t 1☃", k=40)) for _ in range(300)]
    for text in ODD + made:
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_sentence_pieces_match_the_library_and_come_back():
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole, own = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.load("piece_bpe_32k.model")
    random.seed(4)
    made = ["".join(random.choices("abcdet hinorsu éß.,1☃漢\n", k=60)) for _ in range(300)]
    for text, ids in zip(ODD + made, own.encode(ODD + made), strict=True):
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == whole.encode(text), text
        assert own.decode(got) == text


def test_unigram_forward_scores_are_the_best_sums():
    pieces = [("▁a", -1.0), ("b", -2.0), ("▁ab", -4.0), ("c", -3.0), ("bc", -2.5), ("a", -3.0), ("▁", -2.0)]
    own = sentence_pieces.Pieces(pieces, {}, 99, True, {p: i for i, (p, _) in enumerate(pieces)})
    assert np.frombuffer(own.encode(["abc"])[0], "<u4").tolist() == [0, 4]


def _der(tag, body):
    return bytes([tag, len(body)]) + body if len(body) < 128 else bytes([tag, 0x82]) + len(body).to_bytes(2, "big") + body


def test_keys_are_confirmed_by_structure():
    number = lambda n: _der(2, random.Random(n).randbytes(n))
    rsa = _der(0x30, _der(2, b"\0") + b"".join(number(n) for n in (65, 3, 64, 33, 33, 32, 32, 32)))
    assert secret_scan.der_key(rsa)
    assert not secret_scan.der_key(rsa[:-1]) and not secret_scan.der_key(rsa + b"x") and not secret_scan.der_key(b"")
    text = "x " + base64.b64encode(rsa).decode() + " y " + rsa.hex()
    assert [s[2] for s in secret_scan.confirmed_spans(text)] == ["der", "der"]
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(rsa).decode() + "-----END RSA PRIVATE KEY-----"
    assert (3, 3 + len(pem), "pem") in secret_scan.confirmed_spans("é☃ " + pem)
    oid = _der(6, bytes([0x2A, 0x86, 0x48, 0x86, 0xF7, 0x0D, 1, 1, 1])) + _der(5, b"")
    wrapped = lambda inner, name=oid: _der(0x30, _der(2, b"\0") + _der(0x30, name) + _der(4, inner))
    assert secret_scan.der_key(wrapped(rsa)) and not secret_scan.der_key(wrapped(b"not a key at all"))
    assert not secret_scan.der_key(wrapped(rsa, b"\x06\xff" + oid[2:])) and not secret_scan.der_key(wrapped(rsa, _der(6, b"\x2a\x86")))
    curve = _der(0x30, _der(2, b"\1") + _der(4, bytes(range(32))))
    ec = _der(6, bytes([0x2A, 0x86, 0x48, 0xCE, 0x3D, 2, 1])) + _der(6, bytes([0x2A, 0x86, 0x48, 0xCE, 0x3D, 3, 1, 7]))
    assert secret_scan.der_key(curve) and secret_scan.der_key(wrapped(curve, ec)) and not secret_scan.der_key(wrapped(rsa, ec))
    assert secret_scan.der_key(wrapped(_der(4, bytes(32)), _der(6, bytes([0x2B, 0x65, 0x70])))) and not secret_scan.der_key(wrapped(_der(4, bytes(31)), _der(6, bytes([0x2B, 0x65, 0x70]))))
    lines = base64.encodebytes(rsa).decode().strip()
    assert (4, 4 + len(lines), "der") in secret_scan.confirmed_spans("key\n" + lines + "\nend")
    part = lambda x: base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 1})}.{part(b'0' * 32)}"
    assert [s[2] for s in secret_scan.confirmed_spans(f"({token})")] == ["jwt"]
    assert not secret_scan.confirmed_spans(token.replace(part({"sub": 1}), "abcd"))
    assert not secret_scan.confirmed_spans("a" * 5000 + " " + "QUJD" * 40)


def test_base_spans_follow_the_patterns():
    kinds = lambda t: [(k, s, e) for s, e, k in secret_scan.base_spans(t)]
    assert kinds("Token: 'abcdefghijkl' secret=short") == [("assign", 0, 20)]
    assert kinds("ſecret=abcdefghijklmnop") == []
    assert kinds("AKIA" + "A" * 13 + " AKIA" + "B" * 14) == [("access", 18, 36)]


@given(st.text(alphabet="AKIAtokenpassword:= '\"0123456789abcdefxyzſK_.-/\n", max_size=120))
@settings(max_examples=300, deadline=None)
def test_base_spans_are_those_of_the_literal_patterns(text):
    import re

    want = [("assign", m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 12]
    want += [("access", m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    want += [("hex", m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert sorted((k, (s, e)) for s, e, k in secret_scan.base_spans(text)) == sorted(want)


@pytest.mark.parametrize("pack", [warc.member, gzip.compress, lambda x: x])
@pytest.mark.parametrize("want", [None, "response", "revisit"])
def test_records_come_back_and_unwanted_ones_stay_undecoded(pack, want):
    random.seed(1)
    records = [(("response", "revisit")[k % 2], random.randbytes(random.choice([0, 10, 5000, 60000]))) for k in range(40)]
    data = b"".join(pack(warc.header_block([("WARC-Type", t), ("Content-Length", str(len(b)))]) + b + b"\r\n\r\n") for t, b in records)
    source = warc._Source(io.BytesIO(data), lambda h: want in (None, h["warc-type"]))
    assert [(h["warc-type"], b) for h, b in source] == [r for r in records if want in (None, r[0])]
    assert source.decoded == sum(want in (None, t) for t, _ in records)


def test_extraction_keeps_the_article_alone():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <div class="cookie-notice">We use cookies a lot, as you can read here</div><header>Site name</header><nav><ul><li><a href="/">Home</a></ul></nav>
    <article><header><h1>Title &amp; more</h1></header><p>First&nbsp; words <b>here</b>,<br>then a < b.<p>Second one.<div class="ad">Buy this now</div>
    <ul><li>One<li>Two</ul><form>Your mail <input></form><p>Last&hellip;</article><section id="comments"><p>I liked this a lot, thanks for it</section>
    <aside>Other stories</aside><footer>&copy; someone</footer></body>"""
    assert html_extract.extract(page, {}) == "Title & more\n\nFirst words here, then a < b.\n\nSecond one.\n\nOne\n\nTwo\n\nLast…"
    for odd in ("", "<", "<p", "<!-- open", "<script>open", "plain & simple", "</p></div>"):
        assert isinstance(html_extract.extract(odd, {}), str)
    assert html_extract.extract("plain &amp simple", {}) == "plain & simple"


def test_votes_do_not_depend_on_the_batch_and_long_texts_are_whole():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["alpha", "Beta", "γ", "d"], k=rng.choice([0, 1, 2, 50, 9000]))).encode() for _ in range(40)]
    alone = np.concatenate([fingerprint.simhash([t]) for t in texts])
    assert (fingerprint.simhash(texts) == alone).all()
    long = b" ".join(b"w%d" % (k % 5000) for k in range(600_000))
    assert len(fingerprint._cut(long)) > 1
    whole = fingerprint._votes([long], 128)
    parts = sum(fingerprint._votes([p], 128) for p in fingerprint._cut(long))
    assert (whole == parts).all()
    assert (fingerprint.simhash([b"", b"  \n"]) == 0).all()
    assert len(fingerprint.simhash([b"a" * (3 << 20)])) == 1
    # A word longer than a chunk is not cut, wherever it stands.
    for odd in (b"x y " + b"a" * (3 << 20) + b" z w", b"a" * (3 << 20) + b" z", b"z  " + b"a" * (5 << 20), b" " * (3 << 20) + b"a b"):
        assert (fingerprint._votes([odd], 128) == sum(fingerprint._votes([p], 128) for p in fingerprint._cut(odd))).all()


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.integers(0, 10**6))
@settings(max_examples=30, deadline=None)
def test_the_grid_brings_every_near_pair_together(values, seed):
    rng = random.Random(seed)
    for v in list(values):
        for _ in range(rng.randrange(5)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    fps = np.unique(np.array(values, np.uint64))
    cells = {}
    for rows, band, cell, home in simhash_neardup.grid_visits(fps, 3, 2, 1):
        for r, c in zip(rows.tolist(), cell.tolist(), strict=True):
            cells.setdefault((band, c), ([], []))[0 if home else 1].append(r)
    met = {(min(a, b), max(a, b)) for homes, others in cells.values() for a in homes for b in homes + others if a != b}
    near = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert near <= met


def test_a_similarity_grid_brings_its_pairs_together_and_few_others():
    rng = np.random.default_rng(3)
    left = rng.integers(0, 2**64, (20_000, 4), dtype=np.uint64)
    flips = np.packbits(rng.random((len(left), 256)) < np.arccos(1.6 / 1.8) / np.pi, axis=1).view(np.uint64)
    shares = []
    for n in (1000, 10**9):
        bands, bits, turns = simhash_neardup.similarity_grid(n, 0.8, 4)

        def met(right, bands=bands, bits=bits, turns=turns):
            cells = []
            for side in (left, right):
                words = np.concatenate([simhash_neardup.turned(side, t).T for t in range(turns)])
                cells.append(np.stack([cell for w in words for _, _, cell, _ in simhash_neardup.grid_visits(w, bands, bits, 0)]))
            return (cells[0] == cells[1]).any(axis=0).mean()

        assert met(left ^ flips) > 0.995
        shares.append(met(rng.permutation(left)))
    assert shares[0] > 10 * shares[1]


def test_forest_connects_dense_clusters_without_all_pairs():
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = np.unique(np.array([base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)], np.uint64)).reshape(-1, 1)
    a, b = simhash_neardup.forest(fps[:1500], fps[1500:], 4)
    assert len(a) < 5 * len(fps)
    reached, todo = set(), {int(fps[0, 0])}
    edges = {}
    for x, y in zip(a[:, 0].tolist(), b[:, 0].tolist(), strict=True):
        edges.setdefault(x, set()).add(y)
        edges.setdefault(y, set()).add(x)
    while todo:
        x = todo.pop()
        reached.add(x)
        todo |= edges.get(x, set()) - reached
    assert reached == set(fps[:, 0].tolist())


def test_pairwise_terms_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    rows = rng.random((4000, len(quality.FEATURES)))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = quality.fit(rows, labels, rounds=10, pair_rounds=60)
    assert (0, 1) in model.pairs
    assert ((model.score(rows) >= 0.5) == labels).mean() > 0.9
    assert quality.fit(rows[:0], labels[:0]).score(rows[:3]).tolist() == [0.5] * 3
    assert quality.feature_rows(["", " ", "a" * 200_000]).shape == (3, len(quality.FEATURES))


@pytest.mark.parametrize("markup", ["<article class='post no-sidebar'>{}</article>", "<main><article class='post has-share'>{}</article></main>", "<div class='search-result'>{}</div>", "<div class='ad'>" * 300 + "{}"])
def test_names_do_not_drop_most_of_a_page(markup):
    text = "good words here " * 40
    page = "<html><body><nav><a>Menu</a></nav>{}<footer>f g</footer></body></html>"
    assert html_extract.extract(page.format(markup.format(f"<p>{text}</p>")), {}) == text.strip()
    short = f"<article><p>{'short text ' * 10}</p></article>"
    assert html_extract.extract(page.format(short + f"<div class='comments'><p>{text}</p></div>"), {}) == ("short text " * 10).strip()
    assert html_extract.extract(page.format(f"<div class='ad' hidden><p>{text}</p></div>"), {}) == ""


def test_an_article_in_a_sidebar_and_notices_before_the_article():
    text = "good words here " * 40
    page = "<html><body><nav><a>Menu</a></nav>{}<footer>f g</footer></body></html>"
    notice = "<div>" + "this note stands before the article and says something else " * 2 + "</div>"
    assert html_extract.extract(page.format(f"{notice}<article><p>{text}</p></article>"), {}) == text.strip()
    side = "<div class='sidebar'><article><p>teaser of another</p></article><p>more of the sidebar after it</p></div>"
    assert html_extract.extract(page.format(f"<div><p>{text}</p></div>{side}"), {}) == text.strip()
    inner = "<p>Start of it.</p><section class='popular-science'><p>Stars shine.</p></section><p>Let <math><mi>x</mi></math> be.</p><div class='ad'>Buy</div><p>End.</p>"
    assert html_extract.extract(page.format(f"<article>{inner}</article>"), {}) == "Start of it.\n\nStars shine.\n\nLet x be.\n\nEnd."


def _learned(pages):
    table = {}
    for page in pages:
        for key, (a, b) in html_extract.counts(page).items():
            was = table.get(key, (0, 0))
            table[key] = (was[0] + a, was[1] + b)
    return html_extract.weights_from(table)


def test_learned_weights_drop_what_no_name_tells():
    text, odd = "good words here " * 40, "odd box with some words in it"
    labelled = [f"<html><body><div class='zz-box'><p>{odd} {k}</p></div><article><p>{text}</p></article><div class='zz-box'><p>{odd}</p></div></body></html>" for k in range(40)]
    weights = _learned(labelled)
    page = f"<html><body><div class='post'><p>{text}</p></div><div class='zz-box'><p>{odd}</p></div></body></html>"
    assert html_extract.extract(page, {}) == text.strip() + "\n\n" + odd
    assert html_extract.extract(page, weights) == text.strip()
    assert html_extract.extract(labelled[0], weights) == text.strip()


def test_the_scan_cuts_off_what_a_menu_separates():
    text = "good words here " * 40
    page = f"<div><p>a few words</p></div><ul>{'<li><a>menu item</a></li>' * 40}</ul><div><p>{text}</p></div>"
    assert html_extract.extract(page, {}) == text.strip()
    # Without the scan, every word that scores above zero would stay.
    whole = html_extract.Page(page)
    assert any(kind == "word" and piece == "a few words" and html_extract.token_scores(whole, {})[1][e] > 0 for kind, piece, e, _ in whole.tokens)


@given(st.lists(st.integers(-6, 6), max_size=40))
@settings(max_examples=60, deadline=None)
def test_the_stretch_is_the_best_of_all(scores):
    a, b = html_extract.best_stretch([float(x) for x in scores])
    assert sum(scores[a:b]) == max((sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)), default=0)


def test_deep_and_long_pages_are_linear():
    import time

    for page in ("<div>" * 8000 + "end", "<div>" * 8000 + "x</p>" * 8000, "<p>word</p>" * 60_000, "<div class=ad>" * 4000 + "x</div>" * 4000):
        began = time.time()
        assert isinstance(html_extract.extract(page, {}), str)
        assert time.time() - began < 5
