"""HTML extraction, url filters and media columns."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from meridia.llm import html_text as H
from meridia.llm import media as M
from meridia.llm import url_filter as U


def texts(page):
    return [b[1] for b in H.blocks(page)]


def test_blocks():
    got = H.blocks('<html><head><title>t</title><style>p{}</style></head><body><nav><a href="/a">x</a></nav><p class="lead big">A &amp; <b>b</b><br>c<p>d &lt;<script>var a="</p>";</script></body>')
    path = lambda *parts: (H.mask(*parts), len(parts))
    assert [(b[0], b[1]) for b in got] == [(path("html", "body", "nav"), "x"), (path("html", "body", "p", "lead", "big"), "A & b c"), (path("html", "body", "p"), "d <")]
    assert got[0][2] == 1.0 and H.blocks("") == [] and texts("plain <i>text</i> 1 < 2") == ["plain text 1 < 2"]
    assert texts("<p>a</p><!-- x <p>no</p> --><p>b</p><div cla") == ["a", "b"]


def test_tags_are_read_by_attribute_states():
    assert texts("<p title=it's>Hello it's me</p>") == ["Hello it's me"]
    assert texts("<p title='a > b' x=\"<p>\" y>one</p y='>'>two") == ["one", "two"]
    assert texts("<p \">a</p><p =x>b</p><p a=b'c>d</p><a/b>e</a>") == ["a", "b", "d", "e"]
    assert texts("<p>a<p title='never ends>b</p>") == ["a"]
    assert texts("a <3 b </> c <!doctype x> d <?p i?> e <!--> f") == ["a <3 b c d e f"]
    assert H.blocks('<div CLASS=\'Lead\'ID="x"><p>t')[0][0] == (H.mask("div", "lead", "x", "p"), 4)


def test_only_what_the_contract_names_is_skipped():
    for tag in ("math", "object", "noscript", "canvas", "svg", "iframe"):
        assert texts(f"<article><p>the <{tag}>inner</{tag}> text</p><p>more</p></article>") == ["the inner text", "more"], tag
        assert texts(f"<p>the <{tag}>inner</p><p>more") == ["the inner", "more"], tag  # never closed
    assert texts("<p>a<template><p>no<template>no</template></p></template>b<p>c") == ["a", "b", "c"]
    assert texts("<p>a<template><p>kept") == ["a", "kept"]
    assert texts("<p>a<SCRIPT>no</p></script >b<style>no") == ["ab"]
    assert texts("<head><meta x><title>no</title>text<p>more") == ["text", "more"] and texts("<head><link><body>b") == ["b"]
    deep = "<div>" * 5000 + "inner" + "</div>" * 4999 + "outer</div><p>last"
    assert texts(deep) == ["inner", "outer", "last"] and H.blocks(deep)[2][0] == (H.mask("p"), 1)


def plain_logits(net, x):
    """The forward pass of one page, block by block."""
    sigma = lambda v: 1 / (1 + np.exp(-v))
    states = []
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, c, out = np.zeros(H.HIDDEN), np.zeros(H.HIDDEN), {}
        for t in order:
            i, f, o, g = np.split(x[t].astype(float) @ net.p[f"{d}x"] + net.p[f"{d}0"] + h @ net.p[f"{d}h"], 4)
            c = sigma(f) * c + sigma(i) * np.tanh(g)
            h = sigma(o) * np.tanh(c)
            out[t] = h
        states.append(out)
    return [float(np.concatenate([states[0][t], states[1][t]]) @ net.p["o"] + net.p["o0"][0]) for t in range(len(x))]


def test_query_equals_a_plain_forward_pass(spark):
    from meridia.llm.queries import QUERIES

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.text for r in QUERIES["op5_html_extraction"](spark, "/root/testdata/sf0.001").collect()}
    net = H.train()
    for r in pages:
        found = H.blocks(r.html or "")
        z = plain_logits(net, H.vectors([found])[0])
        assert got[r.page_id] == "\n".join(b[1] for b, v in zip(found, z) if v > 0)
    assert len(got) == len(pages)


def test_gradient_is_right():
    net = H.Labeller(1)
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(4, 2, H.SIZE)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = (rng.random((4, 2)) > 0.5).astype(float)
    loss = lambda: float(((np.logaddexp(0, z := net.logits(x, mask)) - y * z) * mask).sum() / mask.sum())
    for key, g in net.gradient(x, mask, y).items():
        at = tuple(int(rng.integers(n)) for n in net.p[key].shape)
        keep = net.p[key][at]
        net.p[key][at] = keep + 1e-5
        up = loss()
        net.p[key][at] = keep - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-5
        net.p[key][at] = keep


def test_held_out_pages(spark):
    rng = np.random.default_rng(77)
    rows, want = [], {}
    while len(rows) < 60:
        page, y = H.training_page(rng)
        found = H.blocks(page)
        if len(found) == len(y):
            want[len(rows)] = "\n".join(b[1] for b, k in zip(found, y) if k)
            rows.append((len(rows), "http://x/", page))
    rows += [(900, None, None), (901, "u", ""), (902, "u", "<p>" * 50_000), (0, "again", rows[0][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = H.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert sum(by[i] == t for i, t in want.items()) >= 50
    assert by[900] == by[901] == by[902] == ""
    assert H.extract(df.where("page_id < 0")).collect() == []


def test_rules_and_reputation(spark):
    urls = ["http://A.Example.org/es/x?q#f", "https://example.org/en/12", "http://b.com/fr/", "http://b.com/de/1", "http://org.net/en", "no scheme", None, "http://bad.com/en/#/", "x://", "http://xexample.org/es/", "HTTP://c.COM"]
    urls += [f"http://bad.com/de/{i}" for i in range(60)]
    df = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, bound double")
    by = {r.page_id: r for r in U.judge(df).collect()}
    assert len(by) == len(urls)
    got = {i: (by[i].host, by[i].path, by[i].rule, by[i].verdict) for i in by}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("b.com", "/fr/", "com/fr/", "allow") and got[3][2:] == ("com/de/", "block")
    assert got[4][:3] == ("org.net", "/en", None) and got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7] == ("bad.com", "/en/", None, "block")  # its host's labelled pages are bad
    assert got[8][:3] == ("", "", None) and got[9] == ("xexample.org", "/es/", "org/", "allow") and got[10][:3] == ("c.com", "", None)
    assert U.judge(df.where("page_id < 0")).collect() == []
    own = U.judge(df.withColumn("bad", df.page_id % 2), outcome_col="bad").count()
    assert own == len(urls)


def plain_adpcm(block):
    """One block, one sample at a time."""
    sample, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(M.STEPS[index])
            delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - delta if code & 8 else sample + delta))
            index = max(0, min(88, index + int(M.ADJUST[code & 7])))
            out.append(sample)
    return out


def test_codecs():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    assert M.adpcm_blocks(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]
    # values of the ITU tables
    assert M.MULAW_TABLE[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert M.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for kind, bits in ((M.MULAW, 8), (M.ALAW, 8), (M.PCM, 16), (M.ADPCM, 4)):
        data = bytes(range(128))
        assert M.read_wav(M.wav(data, kind, 8000, 64 if kind == M.ADPCM else 1, bits))[4] == data
    with pytest.raises(ValueError):
        M.read_wav(b"junk")
    x = (10_000 * np.sin(np.arange(400) / 9)).astype(np.int16)
    assert np.array_equal(M.halve(x), M.resample(x, 8000, 4000))
    assert len(M.resample(x, 8000, 11025)) == -(-400 * 441 // 320)


def test_media_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("aé日 \n") for _ in range(rng.randint(0, 300)))) for i in range(30)] + [(30, None), (31, ""), (32, "x" * 64), (33, "y" * 200_000), (34, "same"), (34, "same")]
    df = spark.createDataFrame([(*r, b"z") for r in rows], "doc_id long, text string, media binary")
    media = M.media_column(df)
    got = M.media_features(media).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    files = {r.id: bytes(r.media) for r in media.collect()}
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (64 - len(raw) if not raw else -len(raw) % 64)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(files[i]) and r.media_sha256 == hashlib.sha256(files[i]).hexdigest()
        kind, rate, _, bits, samples = M.read_wav(bytes(r.pcm))
        assert (kind, rate, bits) == (M.PCM, 4000, 16) and np.array_equal(np.frombuffer(samples, "<i2"), M.resample(M.MULAW_TABLE[np.frombuffer(payload, np.uint8)], 8000, 4000))
        assert r.feature == plain_feature(payload) and r.error is None
    assert M.media_features(M.media_column(df.where("doc_id < 0"))).collect() == []
    broken = [(1, 0, None), (2, 0, b"junk"), (3, 0, b"RIFFxxxxWAVEfmt \0"), (4, 0, M.wav(b"\0" * 64, M.ALAW)), (5, 3, files[0]), (6, 0, M.wav(b"", M.MULAW))]
    found = {r.id: r for r in M.media_features(spark.createDataFrame(broken, "id long, n_bytes long, media binary"), "id").collect()}
    assert [i for i in found if found[i].error is None] == [5] and found[5].feature == by[0].feature and all(found[i].pcm is None for i in (1, 2, 3, 4, 6))


def plain_feature(payload):
    """The feature string, sample by sample."""
    table, alaw = [int(x) for x in M.MULAW_TABLE], [int(x) for x in M.ALAW_TABLE]
    x = [table[b] for b in payload]
    adpcm = sum(s * s for at in range(0, len(payload), 64) for s in plain_adpcm(payload[at : at + 64]))
    pcm = M.resample(np.array(x, np.int16), 8000, 4000).astype("<i2")
    return (
        f"n={len(x)};peak={max(map(abs, x))};energy={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};alaw={sum(alaw[b] ** 2 for b in payload)};adpcm={adpcm}"
        f";pcm={len(pcm)}@4000;pcm_energy={sum(int(v) ** 2 for v in pcm)};pcm_crc={zlib.crc32(pcm.tobytes())}"
    )


def test_long_clips_by_chunks():
    raw = np.random.default_rng(4).integers(0, 256, 64 * 57, dtype=np.uint8)
    want = M.features([raw.tobytes()])[0]
    for chunk in (64, 128, 640, 64 * 57):
        assert M.long_features(raw, chunk) == want
    assert want[0] == plain_feature(raw.tobytes())
