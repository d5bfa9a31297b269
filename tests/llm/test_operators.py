"""Each operator on small inputs against brute force, with nulls, empty texts and tables, repeats and odd columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from gristmill.llm import audio, bpe, fingerprint, licences, mixing, neardup, quality, warc, wrapper
from gristmill.llm import queries as llm_queries

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, texts, more=""):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    # columns of names that operators use themselves
    return df.withColumns({c: F.lit("clash") for c in ("n", "id", "key", "bucket", "canon", "host", "block", "ids")}) if more else df


def words(rng, n, most=300):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % most}" for _ in range(n))


ODD = ["", None, " ", "\n\t", "é ß 中文 😀", "a" * 5000, "x\x1cy\x85z\xa0q"]


# 3: byte-level BPE


def plain_tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark):
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "é", "中", "😀", "1", "22", "'s", "'ll", "_", "!", "%%%", " \n", "\x85", "\xa0", "²", "the", "ing", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(300)] + [words(rng, 4000)]
    library = plain_tokenizer()
    got = bpe.encode(docs(spark, list(enumerate(texts)), "clash"), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        want, text = library.encode_ordinary(texts[r["doc_id"]] or ""), texts[r["doc_id"]] or ""
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == text
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_prefix_table_appends_and_edits():
    rng, vocabulary = random.Random(2), bpe.Vocabulary.load(PATH)
    for _ in range(300):
        data = bytes(rng.choices(b"abc the ing\xc3\xa9", k=rng.randrange(1, 400)))
        table = bpe.PrefixTable(vocabulary, data[: len(data) // 2])
        table.append(data[len(data) // 2 :])
        assert table.last == bpe.PrefixTable(vocabulary, data).last
        i = rng.randrange(len(data) + 1)
        j, new = min(len(data), i + rng.randrange(4)), bytes(rng.choices(b"the q", k=rng.randrange(5)))
        computed = table.replace(i, j, new)
        assert table.data == data[:i] + new + data[j:] and table.last == bpe.PrefixTable(vocabulary, table.data).last
        assert computed <= len(table.data) - i
        assert b"".join(vocabulary.tokens[t] for t in table.ids()) == table.data


# 4: WARC


def test_warc_round_trip(spark):
    long, other = "<p>é</p>" * 300, "<b>" * 400
    rows = [(1, "u1", long), (2, "u2", long), (9, "u9", long), (3, None, other), (4, "u4\r\nX: y", None), (5, "u5", "short"), (6, "u6", "short"), (7, "", ""), (9, "u9", long)]
    got = warc.through_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)), with_payload=True).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if r["page_id"] in (1, 2) else ("response", None))
        assert r["payload"] == (None if r["record_type"] == "revisit" else html.encode())
    assert warc.through_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("step", [1, 97, 1000, 10**6])
def test_warc_ranges_own_each_record_once(step):
    rng = random.Random(3)
    payloads = [bytes(rng.choices(b"ab\x1f\x8b\x08", k=rng.randrange(3000))) + warc.MAGIC for _ in range(12)]
    data = b"".join(warc.member(i, "u", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads))
    read = lambda at, n: data[at : at + n]
    got = [r.headers["x-page-id"] for s in range(0, len(data), step) for r in warc.records_in(read, len(data), s, min(len(data), s + step))]
    assert got == [str(i) for i in range(12)]


def archive(payloads):
    members = [warc.member(i, f"u{i}", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)]
    data = b"".join(members)
    return members, data, lambda at, n: data[at : at + n]


@pytest.mark.parametrize("step", [500, 5000, 40000])
def test_archives_within_payloads_are_no_records(step):
    rng = random.Random(17)
    noise = lambda n: rng.randbytes(n)
    inner = b"".join(warc.member(70 + i, "in", noise(4000), "00" * 20, None) for i in range(5))
    payloads = [noise(3000), noise(30000) + inner + noise(9000), inner, noise(70000) + inner, b"end"]
    members, data, read = archive(payloads)
    assert data.count(warc.MAGIC) > 2 * len(payloads)  # noise is stored as it is
    got = [r.headers["x-page-id"] for s in range(0, len(data), step) for r in warc.records_in(read, len(data), s, min(len(data), s + step))]
    assert got == [str(i) for i in range(len(payloads))]


@pytest.mark.parametrize("step", [700, 10**6])
def test_damaged_archives_raise(step):
    rng = random.Random(18)
    members, data, _ = archive([bytes(rng.choices(b"abcdefgh", k=2000)) for _ in range(12)])
    at = sum(map(len, members[:5])) + len(members[5]) // 2
    for broken in (data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :], data[:-40], data[: len(members[0])] + b"junk" + data[len(members[0]) :]):
        read = lambda a, n, d=broken: d[a : a + n]
        with pytest.raises(warc.Broken):
            [r for s in range(0, len(broken), step) for r in warc.records_in(read, len(broken), s, min(len(broken), s + step))]


def test_urls_come_back_as_they_were(spark):
    urls = [None, "", "http://a/%41?x=1", "http://a/\r\nX: y%0A", " lead and trail\t", "http://é/ü"]
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    got = {r["page_id"]: r["url"] for r in warc.through_archives(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(urls))] == urls


# 2: audio


def test_audio_store_and_features(spark):
    texts = [*ODD, "b" * 576, "same", "same"]
    got = {r["doc_id"]: r for r in audio.audio_features(docs(spark, list(enumerate(texts)), "clash")).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(padded), zlib.crc32(padded[-576:]))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and audio.from_wave(r["media"])[0] == padded
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert audio.tensor_array([x["values"] for x in r["tensors"]]).type.shape == [audio.DEFAULT.frames, audio.DEFAULT.bands]
    assert got[8]["feature"] == got[9]["feature"]


def test_stored_media_and_tensors_give_the_digests(spark, monkeypatch):
    texts = [*ODD, "b" * 576, "same", "same", words(random.Random(3), 4000)]
    d = docs(spark, list(enumerate(texts)), "clash")
    stored = audio.store(d)
    extract = audio.Extractor()
    for r in stored.collect():
        f = extract(audio.from_wave(r["media"])[0])
        t = pa.ipc.open_stream(r["tensors"]).read_all()
        assert t.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), [audio.DEFAULT.frames, audio.DEFAULT.bands])
        assert (t.column("tensor").chunk(0).to_numpy_ndarray() == f.tensors(audio.DEFAULT)).all() and len(r["segments"]) == len(f.spans)
        span = [x["end_s"] - x["start_s"] for x in t.select(["start_s", "end_s"]).to_pylist()]
        assert span == pytest.approx([(15 * 128 + 256) / 8000] * len(span))
    by_id = lambda x: sorted(map(tuple, x.collect()))
    assert by_id(audio.read_back(stored)) == by_id(audio.audio_features(d, with_media=False))
    assert audio.read_back(audio.store(d.limit(0))).count() == 0
    # the query takes its way through the store
    seen, keep = [], audio.store
    monkeypatch.setattr(audio, "store", lambda x: seen.append(keep(x)) or seen[-1])
    assert llm_queries.op2_media_columns(spark, SF).count() == seen[0].count() > 0


def test_media_query_keeps_its_contract(spark, tmp_path):
    texts = [*ODD, "b" * 575, "b" * 576, "b" * 577, "é" * 288, "same", "same", words(random.Random(5), 3000)]
    docs(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        want.add((i, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    got = llm_queries.op2_media_columns(spark, str(tmp_path)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_resampling_keeps_a_tone():
    t = np.arange(12000) / 12000
    out = audio.resample(np.sin(2 * np.pi * 300 * t).astype(np.float32), 2, 3, 12)
    assert len(out) == 8000
    spectrum = abs(np.fft.rfft(out))
    assert abs(int(spectrum.argmax()) - 300) <= 1
    x = np.random.default_rng(0).normal(size=500).astype(np.float32)
    bank = audio.phases(2, 3, 12)
    padded = np.concatenate([np.repeat(x[:1], 6), x, np.repeat(x[-1:], 13)])
    want = [padded[k * 3 // 2 : k * 3 // 2 + 12] @ bank[k * 3 % 2] for k in range(334)]
    assert np.allclose(audio.resample(x, 2, 3, 12), want, atol=1e-5)


def test_segments_have_hysteresis():
    e = np.array([0, 1, 0.5, 0.5, 0.3, 0.5, 0.7, 0.5, 0.0])
    assert audio.segments(e, 0.6, 0.4).tolist() == [[1, 4], [6, 8]] and audio.segments(np.ones(5), 0.6, 0.4).tolist() == []


# 1: main text


def page(i, body, nav="", extra=""):
    return f'<html><head><title>t{i}</title><script>var a="</p>{i}";</script></head><body><header>Site {i}</header><nav><ul><li><a>{nav or i}</a></li></ul></nav><div class="ad">Buy {i}</div>{extra}<main><article>{body}<div class="share">Share this</div><aside>See {i}</aside><form><input>Go</form></article></main><section id="comments"><p>Reader {i} says</p></section><footer>(c) {i}</footer></body>'


def test_main_text(spark):
    rows = [(i, "http://h.org/a", page(i, f"<h1>Title</h1><p>One {i} &amp;&amp; two<br>three\n four<p><b>Bold</b> end &lt;x&gt; {i}</p>")) for i in range(6)]
    rows += [(10, "http://h.org/b", None), (11, None, ""), (12, "http://x.org/", "<p>Alone &eacute;</p><footer>no</footer>"), (13, "http://z.org", "<div><div>"), (14, "h", "plain < text"), (0, "http://h.org/a", rows[0][2])]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit(2)})).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(6):
        assert text[i] == f"Title\n\nOne {i} && two three four\n\nBold end <x> {i}"
    assert [text[i] for i in (10, 11, 12, 13, 14)] == ["", "", "Alone é", "", "plain < text"]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_without_marks_what_varies_is_the_text(spark):
    rows = [(i, "http://p.org/x", f"<body><div><span>Home</span> <span>About</span></div><div><p>Story {i} {'word ' * (30 + i)}</p><p>More {i}</p><div>Printed in Rome</div></div></body>") for i in range(5)]
    for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r["text"].startswith(f"Story {r['page_id']} ") and "Home" not in r["text"] and "Rome" not in r["text"] and r["text"].endswith(f"More {r['page_id']}")


def test_a_block_that_few_pages_share_is_the_articles(spark):
    same = {"quote": "<blockquote><p>The same quotation</p></blockquote>", "table": "<table><tr><td>Same cell</td></tr></table>", "pre": "<pre>same code</pre>"}
    story = lambda i, more="": f"<body><article><h1>Title {i}</h1><p>Story {i} {'word ' * (30 + i)}</p>{more}<p>More {i}</p><div>Printed in Rome</div></article></body>"
    rows = [(i, "http://q.org/x", story(i, same["quote"] if i < 3 else same["table"] if i < 6 else "")) for i in range(20)]
    # most rows of the host are copies of one page
    rows += [(100 + i, "http://c.org/x", story(1, same["pre"])) for i in range(5)] + [(200 + i, "http://c.org/x", story(2 + i)) for i in range(3)]
    text = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(text) == len(rows) and not any("Rome" in t for t in text.values())
    for i, _, html in rows:
        assert [x in text[i] for x in ("The same quotation", "Same cell", "same code")] == [x in html for x in ("The same quotation", "Same cell", "same code")]


def test_many_differing_sections_keep_the_template(spark):
    section = lambda i, j: f"<div class='s{'abcdefghij'[j % 10]}x{'klmnopqrst'[j // 10 % 10]}'><h4>{i} {j}</h4><p>text {i * 7919 + j}</p></div>"
    rows = [(i, "http://big.org/x", f"<body><div><span>Home | About us | Imprint</span></div><div>{''.join(section(i, j) for j in range(1500))}</div><div><p>Printed in Rome</p></div></body>") for i in range(4)]
    for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert "Imprint" not in r["text"] and "Rome" not in r["text"] and r["text"].count("text ") == 1500


def test_slots_of_few_pages_are_pruned_but_counted():
    pages = [f"<body><div><p>{'word ' * 20}{i}</p><div class='{chr(97 + i % 26)}{chr(97 + i // 26)}z'><p>own {i}</p></div></div><div>Same</div></body>" for i in range(200)]
    template = wrapper.fold([("h", p) for p in pages], wrapper.Aligner())["h"]
    nodes = wrapper.numbered(template, [])
    assert template.pages == 200 and len(nodes) < 20 * wrapper.RARE and sum(x.loose for x in nodes) > 0
    assert wrapper.unpack(wrapper.pack(template)) == template


def test_templates_merge_in_any_split():
    pages = [page(i, f"<p>Text {i}</p>") for i in range(8)]
    whole = wrapper.fold([("h", p) for p in pages], wrapper.Aligner())["h"]
    a, b = (wrapper.fold([("h", p) for p in part], wrapper.Aligner())["h"] for part in (pages[:3], pages[3:]))
    assert wrapper.pack(wrapper.Aligner().merge(a, b)) == wrapper.pack(whole)


# 5: near duplicates


def brute_links(texts, percent=85):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(rng, n):
    out = []
    for _ in range(n):
        base = words(rng, rng.randrange(20, 200), 5000).split()
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 60))):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            out.append(" ".join(w))
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):  # each is like the next, the ends aren't
        out.append(" ".join(chain[i * 5 : i * 5 + 140]))
    passage = " ".join(f"p{i}" for i in range(60))
    return out + [f"{words(rng, 20, 9000)} {passage} {words(rng, 20, 9000)}" for _ in range(20)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = list(enumerate([*ODD, "one two", "ONE  two", "one two three", *copies(rng, 40)]))
    rng.shuffle(texts)
    df = docs(spark, texts, "clash").union(docs(spark, [texts[0]], "clash"))
    got = neardup.near_duplicates(df).collect()
    want = brute_links(texts)
    assert len(got) == len(texts) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    left = neardup.keep_first(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    null = neardup.near_duplicates(docs(spark, [(None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in null} == {(None, None), (1, 1)}


def test_a_key_with_several_texts_links_by_each(spark):
    base = [f"b{i}" for i in range(120)]
    one, other, near = " ".join(f"a{i}" for i in range(60)), " ".join(base), " ".join([*base[:-1], "else"])
    texts = [(5, one), (5, other), (8, other), (9, other), (7, near), (4, one + " more"), (6, "quite another text of six words"), (3, None)]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, texts * 2)).collect()}
    assert got == {(i, 4) for i in (4, 5, 7, 8, 9)} | {(6, 6), (3, 3)}
    assert sorted(r["doc_id"] for r in neardup.keep_first(docs(spark, texts[::-1])).collect()) == [3, 4, 6]


def test_lower_limits_link_more(spark):
    rng, texts = random.Random(16), []
    for _ in range(60):  # pairs between 0.75 and 0.9
        base = words(rng, 120, 5000).split()
        other = list(base)
        for k in range(rng.randrange(2, 6)):
            other[k * 20 + 7] = f"e{rng.random()}"
        texts += [" ".join(base), " ".join(other)]
    texts = list(enumerate(texts))
    assert brute_links(texts, 80) != brute_links(texts)
    for percent in (80, 85):
        got = neardup.near_duplicates(docs(spark, texts), percent=percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_links(texts, percent)
    assert (neardup.Limit(85).chunks, neardup.Limit(80).chunks, neardup.Limit(85).far) == (8, 11, 47)


def test_own_names_may_be_taken(spark):
    """Columns of every name that the operators give within."""
    names = ["__key", "__KEY_", "__doc", "__row", "__rate", "__replica", "__cdf", "__u", "__first", "__source", "__text", "__hot", "__component", "__n", "class", "copies", "whole"]
    texts = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n"), (None, "o p")]
    df = docs(spark, texts).withColumns({c: F.lit("own") for c in names})
    once = neardup.keep_first(df)
    assert once.columns == df.columns and sorted((r["doc_id"] or 0, r["__key"]) for r in once.collect()) == [(0, "own"), (1, "own"), (3, "own")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    good = quality.keep_good(df, labels)
    assert good.columns == df.columns and good.count() == 4 and good.select("__row").distinct().count() == 1
    mixed = mixing.mix(df, flatten=1.0)
    again = neardup.keep_first(mixed)
    assert again.columns == mixed.columns and set(r["doc_id"] for r in again.collect()) <= {1, 3, None}


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIDE", 3)
    texts = list(enumerate(copies(random.Random(6), 12)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_links(texts)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_signatures_under_the_distance_share_a_key(percent):
    limit = neardup.Limit(percent)
    rng = np.random.default_rng(7)
    a = rng.integers(0, 256, (200, neardup.LONG), dtype=np.uint8)
    b = a.copy()
    for row in b:
        at = rng.choice(limit.chunks * neardup.SLOTS, limit.distance - 1, replace=False)
        row[at] += 1
    x, y = neardup.chunk_keys(a, limit.chunks), neardup.chunk_keys(b, limit.chunks)
    shared = x == y
    assert shared.any(axis=1).all()
    assert [neardup.first_shared(p, q[None], limit.chunks)[0] for p, q in zip(a, b, strict=True)] == shared.argmax(axis=1).tolist()


def test_long_words_and_blocks_hash_alike(monkeypatch):
    text = ("abc " * 50 + "long" * 300 + " end ").encode()
    whole = neardup.word_hashes(text)
    monkeypatch.setattr(neardup, "BLOCK", 64)
    cut = neardup.word_hashes(text)
    assert len(whole) == len(cut) == 52 and (whole[:50] == cut[:50]).all() and whole[51] == cut[51]
    assert (cut == neardup.word_hashes(text)).all()


# 6: fingerprints


def test_fingerprints(spark):
    rng = random.Random(8)
    texts = list(enumerate([*ODD, "Straße  ＡＢＣ", "STRASSE abc", "é", "é", *(words(rng, rng.randrange(60)) for _ in range(40))]))
    texts += [(7, "again"), (None, "no id")]
    order = sorted(((-math.inf if i is None else i), t or "") for i, t in texts)
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        want[(None if i == -math.inf else i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest())] += 1
    df = docs(spark, texts, "clash")
    got = fingerprint.edited_pairs(df).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[7 + 1]["fingerprint"] == fingerprint.fingerprints(docs(spark, [(1, "strasse ABC")])).first()["fingerprint"]
    assert by[9]["fingerprint"] == by[10]["fingerprint"] and by[9]["near_next"] == 1.0 and by[0]["fingerprint"] == by[1]["fingerprint"]
    assert all((r["near_edited"] == 1.0) == (r["fingerprint"] == r["edited_fingerprint"]) for r in got)
    assert fingerprint.edited_pairs(df.limit(0)).count() == 0


def test_equal_hashes_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "hashes", lambda canon: [F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long")])
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs(spark, [(1, "a"), (2, "B"), (3, "A"), (4, "b")])).collect()}
    assert got[1] == got[3] != got[2] == got[4]


# 7: quality


def test_quality_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter("doc_id % 3 <> 0")
    got = quality.classify(d, train).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = sum(r["keep"] == (r["quality"] is not None and r["prior"] is not None and r["keep"]) for r in got)
    assert right == len(got)
    judged = {r["doc_id"]: r["keep"] for r in got}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(judged[i] == bool(truth[i]) for i in judged) >= 0.97 * len(judged)
    assert sum(not judged[i] for i in judged if truth[i]) <= 0.01 * len(judged)


def test_quality_shrinks_sparse_sites(spark):
    rng = random.Random(9)
    good, bad = (lambda: words(rng, 60, 10**6)), (lambda: "buy " * 60)
    rows = [(i, bad() if i % 2 else good(), "a", "bad" if i % 2 else "good", 0) for i in range(200)] + [(500, good(), "a", "lone", 0), (501, None, None, None, 0), (502, "", "a", "good", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(100)] + [(1, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(d.withColumn("host", F.lit(1)), labels).collect()}
    assert len(got) == len(rows) and got[0]["keep"] and not got[101]["keep"]
    overall = sum(r["evidence"] for r in got.values()) / len(got)
    # a document by itself has no prior but the overall one: its own evidence isn't counted twice
    assert got[101]["prior"] < overall < got[0]["prior"] and got[500]["prior"] == pytest.approx(overall)
    assert quality.keep_good(d, labels).columns == d.columns
    none = labels.limit(0)
    assert quality.keep_good(d, none).count() == len(rows) and quality.classify(d.limit(0), none).count() == 0


# 8: licences


def test_licences(spark):
    texts = [
        (1, "Text first.\nLicensed under the Apache License, Version 2.0.\nMore"), (2, "Released under the MIT License."), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "x\nLicensed under CC BY-NC 4.0."), (5, "He got his driving license in May.\nNothing here"), (6, None), (7, ""), (8, "one " * 3000 + "\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0."), (2, "Released under the MIT License."),
    ]
    got = licences.scan(docs(spark, texts, "clash")).collect()
    assert Counter((r["doc_id"], r["families"]) for r in got) == Counter([(1, "apache"), (2, "mit"), (2, "mit"), (3, "gpl"), (4, "cc-by-nc"), (5, ""), (6, ""), (7, ""), (8, "cc-by-nc,mit")])
    assert all(x["confirmed"] for r in got for x in r["licences"])
    assert next(r for r in got if r["doc_id"] == 1)["licences"][0]["paragraph"] == 2
    assert licences.scan(docs(spark, texts).limit(0)).count() == 0


def test_notices_without_the_usual_words_are_scored(spark):
    texts = [(1, "Distributed under GPLv3 or later"), (2, "Dual use under Apache-2.0 or MIT"), (3, "x\nNo part of this publication may be reproduced"), (4, "Unless required by applicable law or agreed to in writing, software"), (5, "Er kam mit der Bahn und mit dem Rad.\nWir fahren mit.")]
    got = {r["doc_id"]: r["families"] for r in licences.scan(docs(spark, texts)).collect()}
    # two families at once may be named as unknown
    assert got[1] == "gpl" and got[2] in ("apache", "mit", "unknown") and got[3] == "proprietary" and got[4] == "apache" and got[5] == ""


def test_wrapped_notices_are_one_paragraph(spark):
    apache = licences.TEMPLATES["apache"][2].replace("writing, software ", "writing, software\n").replace("WITHOUT WARRANTIES", "WITHOUT\nWARRANTIES")
    got = licences.scan(docs(spark, [(1, "Prose here.\n" + apache.replace("WITHOUT\nW", "without\r\n  w") + "\nMore prose."), (2, "one line\nNext line")])).orderBy("doc_id").collect()
    assert got[0]["n_paragraphs"] == 3 and [(x["paragraph"], x["family"]) for x in got[0]["licences"]] == [(2, "apache")] and got[1]["n_paragraphs"] == 2


def test_licence_model_on_other_paragraphs():
    model, found = licences.train(), Counter()
    for family, text in licences.examples(77, 6):
        found[family in licences.TEMPLATES, family, model.family(text)] += 1
    of = lambda f: sum(n for k, n in found.items() if f(*k))
    # a piece of a notice may be too little to believe a family, but it isn't another one's
    assert of(lambda k, f, g: k and f == g) >= 0.82 * of(lambda k, f, g: k) and of(lambda k, f, g: k and g in licences.TEMPLATES and f != g) <= 0.03 * of(lambda k, f, g: k)
    assert of(lambda k, f, g: f == licences.NONE == g) >= 0.97 * of(lambda k, f, g: f == licences.NONE)
    assert of(lambda k, f, g: f == licences.UNKNOWN and g in licences.TEMPLATES) <= 0.03 * of(lambda k, f, g: f == licences.UNKNOWN)


@pytest.mark.parametrize("left", ["apache", "bsd", "cc-by-sa", "mpl"])
def test_a_family_that_was_never_seen_is_unknown(left):
    model = licences.train.__wrapped__(without=left)
    got = Counter(model.family(t) for f, t in licences.examples(9, 16) if f == left)
    assert sum(n for f, n in got.items() if f in licences.TEMPLATES) <= 0.1 * got.total() and got[licences.UNKNOWN] >= 0.9 * (got.total() - got[licences.NONE])


def test_licences_outside_the_families():
    model = licences.train()
    for text in ("GNU Affero General Public License v3.0", "Licensed under the Ruby License.", "Distributed under the terms of the Eclipse Public License.", "This file is licensed under the Artistic License 2.0."):
        assert model.family(text) == licences.UNKNOWN, text
    for text in ("Licensed under the GNU General Public License v2", "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.", "Copyright 2019 Some Press. All rights reserved."):
        assert model.family(text) not in (licences.UNKNOWN, licences.NONE), text


def test_texts_without_telling_words_have_no_licence():
    model, rng = licences.train(), random.Random(15)
    telling = set(model.telling)
    rest = sorted({w for g in model.weights for w in g.split() if w not in telling})
    assert telling and not telling & licences.GENERIC
    for n in (1, 3, 10, 100, len(rest)):
        for _ in range(30):
            assert model.family(" ".join(rng.sample(rest, min(n, len(rest))))) == licences.NONE
    # the most that such n-grams can add up to, whether or not a text can hold them all
    left = [w for g, w in model.weights.items() if not set(g.split()) & telling]
    scores = [b - model.bias[-1] + sum(max(0.0, w[i] - w[-1]) for w in left) for i, b in enumerate(model.bias[:-1])]
    assert sum(map(math.exp, scores)) < model.least


def test_licence_scores_equal_plain_ones(spark):
    model = licences.train()
    texts = [t for _, t in licences.examples(5, 1)][:60]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licences.classify_paragraph(F.col("t"), model).alias("c"))
    for r in df.collect():
        family, (name, licence, odds, similarity) = model.family(r["t"]), model.evidence(r["t"])
        assert r["c"]["family"] == family
        best = max(model.probabilities(r["t"])[:-2])
        assert r["c"]["probability"] == pytest.approx(1 - licence if family == licences.NONE else licence if family == licences.UNKNOWN else best)
        assert r["c"]["similarity"] == pytest.approx(0.0 if family == licences.NONE else similarity)


# 9: mixing


def test_mixing(spark):
    rng = random.Random(10)
    rows = [(i, words(rng, 20), "en", "big" if i % 4 else None if i % 8 else "small", 0) for i in range(2000)] + [(5000, None, "en", "mute", 0), (None, "no id", "en", "big", 0)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("rate", F.lit(1)).withColumn("__key", F.lit(1))
    rates = {r["__source"]: r for r in mixing.source_rates(d).collect()}
    assert rates["mute"]["rate"] is None and sum(r["weight"] or 0 for r in rates.values()) == pytest.approx(1)
    got = mixing.mix(d).collect()
    n = Counter(r["doc_id"] for r in got)
    assert n[5000] == 1
    for source, r in rates.items():
        if r["rate"]:
            mine = [i for i, _, _, s, _ in rows if s == source and i is not None]
            assert sum(n[i] for i in mine) / len(mine) == pytest.approx(r["rate"], abs=4 * math.sqrt(r["rate"] / len(mine)))
    for r in got[:300]:
        if r["__rate"]:
            u, k, term = int(hashlib.md5(f"17:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-r["__rate"])
            total = term
            while total <= u:
                k += 1
                term *= r["__rate"] / k
                total += term
            assert n[r["doc_id"]] == k
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))
    assert mixing.mix(d, {"big": 1.0}).filter("source = 'small'").count() == 0 and mixing.mix(d.limit(0)).count() == 0
    huge = mixing.source_rates(d, {"small": 1.0}).filter("rate > 0").first()
    assert len(huge["cdf"]) > huge["rate"] and abs(huge["cdf"][-1] - 1) < 1e-9


def test_large_rates_draw_the_right_mean(spark):
    rows = [(i, "x" * (10 if i % 2 else 1), "en", "few" if i < 6 else "many", 0) for i in range(4000)]
    rates = {r["__source"]: r for r in mixing.source_rates(spark.createDataFrame(rows, SCHEMA), {"few": 0.9999, "many": 0.0001}).collect()}
    few = rates["few"]
    assert few["rate"] > 500 and few["first"] > 0 and len(few["cdf"]) < 30 * math.sqrt(few["rate"]) + 100 and few["cdf"][-1] == pytest.approx(1, abs=1e-9)
    mean = sum((few["first"] + k) * (p - q) for k, (p, q) in enumerate(zip(few["cdf"], [0, *few["cdf"]], strict=False)))
    assert mean == pytest.approx(few["rate"], rel=1e-6)


def test_next_text_over_ranges_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 64)
    rows = [(i * 7 % 50, f"text {i} " + "x" * (i % 9 * 20)) for i in range(50)] + [(3, "twin"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted((fingerprint.NO_ID if k is None else k, t or "") for k, t in rows)
    want = sorted((k, t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    got = fingerprint.with_next(docs).collect()
    assert sorted((fingerprint.NO_ID if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["next_text"]) for r in got) == want
    assert fingerprint.with_next(docs.limit(0)).collect() == [] and fingerprint.edited_pairs(docs.limit(0)).collect() == []
