"""Operators 1, 2, 4 and 5: urls, audio, html, tokens."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import audio, bpe, lineblock, url_lm

TEXTS = [None, "", " ", "a", "It's  a\n\ntest's <|endoftext|>ok", "é́ 日本 😀 a b", "x" * 5000 + "  \t\n y", "word, " * 3000, "It's  a\n\ntest's <|endoftext|>ok"]


def frame(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "doc_id long, text string, id double")


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.default_path())
    tk.no_truncation(), tk.no_padding()
    rng = random.Random(5)
    parts = ["a", "B", "'s", "'", " ", "  ", "\n", "\t", "1", "é", "!", ".", "<|endoftext|>", "日", " ", "\x1c", "\r", "-", "'ll", "😀"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    n, ids, back = bpe.coder(bpe.default_path()).encode(pa.array(texts, pa.string()))
    for t, k, i, b in zip(texts, n, ids, back, strict=True):
        want = tk.encode(t or "", add_special_tokens=False).ids
        assert ",".join(map(str, want)).encode() == i and k == len(want)
        assert tk.decode(want, skip_special_tokens=False).encode() == b
    got = {r["doc_id"]: r for r in bpe.encode_decode(frame(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    assert got[0]["n_tokens"] == 0 and got[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["decoded_sha256"] == hashlib.sha256(TEXTS[4].encode()).hexdigest() == got[8]["decoded_sha256"]
    assert bpe.encode_decode(frame(spark, TEXTS).limit(0)).count() == 0


def test_bpe_of_long_texts(spark):
    from tokenizers import Tokenizer

    long = "It's a very long, very long text: naïve\n\n  tabs\tand 日本. " * 20_000
    want = Tokenizer.from_file(bpe.default_path()).encode(long, add_special_tokens=False).ids
    rows = bpe.encode_decode(frame(spark, [long, None, long]), keep=["id"]).collect()
    assert [(r["n_tokens"], r["ids_sha256"]) for r in rows if r["doc_id"] != 1] == [(len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())] * 2


def test_no_cut_pair_is_inside_a_token():
    b = bpe.coder(bpe.default_path())
    for raw in b.bytes_of:
        row = np.frombuffer(raw, np.uint8)
        if raw.decode("utf-8", "ignore") not in b.added:
            assert not b.cut[row[:-1], row[1:]].any()


def test_audio_payload_round_trip(spark):
    rows = audio.features(audio.store(frame(spark, TEXTS)), keep=["n_bytes", "media"])
    got = {r["doc_id"]: r for r in rows.collect()}
    dig = {r["doc_id"]: r for r in audio.digest(rows).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert bytes(got[i]["payload"]) == padded and got[i]["n_bytes"] == len(raw)
        assert dig[i]["payload_sha256"] == hashlib.sha256(padded).hexdigest() and dig[i]["tail_crc32"] == zlib.crc32(padded[-64:])
        assert dig[i]["media_sha256"] == hashlib.sha256(got[i]["media"]).hexdigest() and dig[i]["media_bytes"] == len(got[i]["media"])
        tensors = audio.read_tensors(bytes(got[i]["tensors"]))
        assert tensors.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (32, 20))
        assert tensors.num_rows == -(-got[i]["n_frames"] // 32)
    assert dig[4]["feature"] == dig[8]["feature"] and dig[0]["feature"] == dig[1]["feature"]
    assert audio.features(audio.store(frame(spark, TEXTS).limit(0))).count() == 0


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 2), (2, 3)])
def test_resampling_keeps_a_tone(up, down):
    y = audio.resample(np.sin(2 * np.pi * 440 * np.arange(16000) / 16000).astype(np.float32), up, down)
    spectrum = np.abs(np.fft.rfft(y[: 8000 * up // down]))
    assert len(y) == -(-16000 * up // down)
    assert abs(spectrum.argmax() * (16000 * up / down) / (8000 * up // down) - 440) < 3


@pytest.mark.parametrize(("up", "down"), [(3, 4), (2, 3), (5, 2)])
def test_resampling_by_convolution(up, down):
    x = np.random.default_rng(3).normal(size=301).astype(np.float32)
    taps = 16
    h = audio.phase_filters(up, down, taps)[:, ::-1].T.ravel()  # one long filter again
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    full = np.concatenate([np.convolve(stuffed, h), np.zeros(taps * up)])
    want = full[np.arange(-(-len(x) * up // down)) * down + taps // 2 * up]
    assert np.allclose(audio.resample(x, up, down, taps), want, atol=1e-4)


@pytest.mark.parametrize("n", [64, 1000, 20_000])
def test_tensors_by_naive_transform(n):
    p = audio.AudioParams(block=7)
    x = np.random.default_rng(n).normal(size=n).astype(np.float32)
    mel, energy = audio.log_mel(x, 12_000, p)
    frames = 1 + max(0, -(-(n - p.frame) // p.hop))
    padded = np.concatenate([x, np.zeros(p.frame)])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(p.frame) / (p.frame - 1))
    wave = np.exp(-2j * np.pi * np.outer(np.arange(p.frame // 2 + 1), np.arange(p.frame)) / p.frame)
    at = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + 6000 / 700), p.mels + 2)]
    assert mel.shape == (frames, p.mels)
    for f in {0, frames // 2, frames - 1}:
        part = padded[f * p.hop : f * p.hop + p.frame]
        power = np.abs(wave @ (part * window)) ** 2
        for k in range(p.mels):
            lo, mid, hi = at[k : k + 3]
            hz = np.arange(p.frame // 2 + 1) * 12_000 / p.frame
            weight = np.clip(np.minimum((hz - lo) / (mid - lo), (hi - hz) / (hi - mid)), 0, None)
            assert np.isclose(mel[f, k], np.log(weight @ power + 1e-6), atol=1e-3)
        assert np.isclose(energy[f], 10 * np.log10(np.mean(part**2) + 1e-10), atol=1e-3)
    back = audio.read_tensors(audio.tensor_stream(mel, 1 / 12_000, p))
    values = np.concatenate([np.array(t.as_py()).reshape(p.tensor_frames, p.mels) for c in back["log_mel"].chunks for t in c.storage])
    assert np.array_equal(values[:frames].astype(np.float32), mel) and not values[frames:].any()
    assert back["start_s"].to_pylist() == pytest.approx([k * p.tensor_frames * p.hop / 12_000 for k in range(back.num_rows)])


def test_audio_of_long_and_repeated_media(spark):
    long = "né, " * 400_000
    rows = audio.features(audio.store(frame(spark, [long, long, None])), keep=["n_bytes", "media"])
    a, b, c = audio.digest(rows).orderBy("doc_id").collect()
    assert a[1:] == b[1:] and a["n_bytes"] == len(long.encode()) and a["tensors_sha256"] != c["tensors_sha256"]
    with pytest.raises(ValueError):
        audio.wav_bytes(type("Long", (bytes,), {"__len__": lambda self: 1 << 32})(), 8000)


def test_hysteresis():
    assert audio.hysteresis(np.array([0, 1, 2, 3, 1, 0, 1, 1, 0, 3.0]), 1, 3) == [(1, 5), (9, 10)]


PAGE = """<html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body><nav><a href=x>Home</a></nav>
<div id="cookie-notice">We use cookies, please accept all of them now.</div><%s><h1>Title &amp; x</h1><p><b>First   paragraph
is here, long enough to be text.<br><p>Second &#233;.</p><div class="ad">Buy now</div><p>Of.</p></%s>
<div class="comments"><p>A reader says something very long indeed, with many words in it.</p></div><form><label>Mail</label></form><footer>(c) 2020</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_line_block(spark, tag):
    want = "Title & x\n\nFirst paragraph is here, long enough to be text.\n\nSecond é.\n\nOf."
    assert lineblock.extract_text(PAGE % (tag, tag)) == want
    pages = spark.createDataFrame([(1, "u", PAGE % (tag, tag), 3), (2, None, None, 3), (3, "v", "", 3), (3, "v", "<p>", 3)], "page_id long, url string, html string, n_chars int")
    rows = lineblock.extract(pages).collect()
    assert all((r["surge_line"] < 0) == (r["text"] == "") for r in rows)
    got = sorted((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in rows)
    assert got == [(1, "u", want, len(want)), (2, "", "", 0), (3, "v", "", 0), (3, "v", "", 0)]


LONG = ["Word %d of a paragraph of the text. " % k * 30 for k in range(6)]


def test_line_block_chooses_the_text_among_marked_teasers():
    teasers = "".join(f"<article><h3>Teaser {k}</h3><p>Read on.</p></article>" for k in range(4))
    text = ["A headline", *(t.strip() for t in LONG)]
    story = "<div id=text><h1>A headline</h1>" + "".join(f"<p>{t}</p>" for t in LONG) + "</div>"
    for page in (teasers + story, story + teasers):
        assert lineblock.extract_text(f"<html><body>{page}</body></html>").split("\n\n") == text


def test_line_block_windows_decide_on_unmarked_pages():
    """Every paragraph in an element of its own, short unnamed ones around and between."""
    box = "<div><p>{}</p></div>".format
    short = ["Popular", "Contact", "Places"]
    body = [*map(str.strip, LONG[:3]), "A short line.", "And one more.", *map(str.strip, LONG[3:])]
    page = "<html><body>" + "".join(map(box, [*short, *body, *short, "x"])) + "</body></html>"
    assert lineblock.extract_text(page).split("\n\n") == ["Contact", "Places", *body]  # the windows of three reach two lines ahead
    assert lineblock.extract_text(page, window=1).split("\n\n") == body[:3]
    assert lineblock.extract_text(page, window=2, surge=0.02).split("\n\n") == body[4:]
    assert lineblock.extract_text(page, surge=0.0).split("\n\n") == [*short, *body, *short, "x"]


def test_line_block_stretches_by_brute_force():
    r = random.Random(12)
    for _ in range(500):
        lengths = [r.choice((1, 2, 5, 40, 200)) for _ in range(r.randint(1, 25))]
        window, surge = r.randint(1, 5), r.choice((0.0, 0.05, 0.3, 0.9))
        sums = [sum(lengths[k : k + window]) for k in range(len(lengths))]
        above = [s > surge * max(sums) for s in sums]
        runs = [(a, b) for a in range(len(lengths)) for b in range(a + 1, len(lengths) + 1) if all(above[a:b]) and (a == 0 or not above[a - 1]) and (b == len(lengths) or not above[b])]
        assert lineblock.stretch_of(lengths, window, surge) == max(runs, key=lambda x: (sum(lengths[x[0] : x[1]]), -x[0]))


def test_line_block_of_long_pages(spark):
    page = "<body><article>" + "<p>A line of the text.</p>" * 60_000 + "</article><p>After it.</p></body>"
    rows = lineblock.extract(spark.createDataFrame([(1, "u", page, 0), (1, "u", page, 0)], "page_id long, url string, html string, surge_line int")).collect()
    assert rows[0] == rows[1] and rows[0]["text"].count("A line of the text.") == 60_000 and "After" not in rows[0]["text"]


@pytest.mark.parametrize("around", ["<div>%s</div>", "%s"])
def test_line_block_keeps_the_whole_text(around):
    advert = "<div class=ad><p>Buy</p><p>this</p><p>now</p><p>here</p></div>"
    lead = ["Head", "By A. Writer", "A lead.", "It has", "lines of", "few words."]
    parts = [*(f"<p>{t}</p>" for t in [*lead, *LONG[:3]]), advert, *(f"<p>{t}</p>" for t in LONG[3:])]
    page = f"<html><body><nav><a href=x>Home</a></nav>{around % ''.join(parts)}<footer>(c)</footer></body></html>"
    assert lineblock.extract_text(page).split("\n\n") == [*lead, *(t.strip() for t in LONG)]


URLS = ["http://A.example.com/en/71?x", "https://b.com/en/1", "http://c.net/de/#x", "http://example.net/de/8", "ftp://d.org/es/2", "http://com/en/", "http://e.com", None, "", "no scheme", "http://x.fr/aé日/", "http://b.com/en/1", "http://long.example.org/es/" + "ab/" * 2000] + [f"http://h{i}.example.{t}/{lang}/{i}" for i in range(60) for t in ("com", "net", "org") for lang in ("en", "de", "fr")]


def test_url_filter_matches_sql(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = url_lm.url_filter(pages).toPandas().sort_values("page_id")
    pdf = pages.toPandas()
    con = duckdb.connect()
    con.register("pages", pdf)
    want = con.execute(url_lm.oracle()).df().sort_values("page_id")
    cols = ["page_id", "host", "path", "rule", "verdict", "by_model"]
    clean = lambda d: d[cols].astype(object).where(d[cols].notna(), None).values.tolist()
    assert clean(got) == clean(want)
    by = dict(zip(got["page_id"], zip(got["host"], got["path"], got["rule"], got["verdict"], strict=True), strict=True))
    assert by[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and by[7][:2] == ("", "")
    assert by[3][2:] == ("example.net/de/8", "block") and by[5][2] == "com/en/"
    assert url_lm.url_filter(pages.limit(0)).count() == 0


def test_url_rules_say_what_the_contract_lists(spark):
    says = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = {"http://a.com/en/1": "com/en/", "http://example.com/en/7": "example.com/en/7", "http://a.example.net/de/7": "net/de/", "https://net/de/": "net/de/", "http://b.example.net/de/8": "example.net/de/8", "http://c.org/es/1": "org/es/"}
    assert dict(url_lm.RULES) == says
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = [(i, rule, says[rule]) for i, rule in enumerate(urls.values())]
    assert sorted(tuple(r) for r in url_lm.url_filter(pages).select("page_id", "rule", "verdict").collect()) == want
    assert con.execute(f"SELECT page_id, rule, verdict FROM ({url_lm.oracle()}) ORDER BY 1").fetchall() == want
