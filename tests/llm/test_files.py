"""Byte-level BPE, token files and WARC archives: exact round trips against the public libraries."""

import base64
import gzip
import hashlib
import io
import re
import sys
import time
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratum.llm import common, token_store, warc
from stratum.llm.byte_bpe import codec, encode_decode
from stratum.llm.common import filesystem
from stratum.llm.minhash import sign

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "The idiot's é ñ ß—\n\n  x y 12345 ###$$$", "日本語 текст 🎉", "ab" * 3000, "\x00\x01 �", "don't  stop\t\r\n  ", "aaaaaaaa " * 50]


def u32(ids):
    return np.array(ids, np.uint32).tobytes()


def reference():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_tiktoken(spark):
    path, ref = P.path("byte_bpe_multi_50k.tiktoken"), reference()
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (None, "the same"), (None, "the same")]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = encode_decode(df, "text", path, P.PATTERN).collect()
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"])) for r in out))
    assert got == sorted((i is not None, i or 0, u32(ref.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert encode_decode(df.limit(0), "text", path, P.PATTERN).count() == 0


def _word(rng, letters: str, n: int) -> str:
    return "".join(rng.choice(list(letters), n))


def test_bpe_of_long_pieces():
    """Pieces around and far over LONG_PIECE: runs, periods, few letters, many letters, letters of real text."""
    c, ref, rng = codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), reference(), np.random.default_rng(2)
    low = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * 100_000, "ab" * 2000, "aab" * 900 + "b", "-" * 3001, " " * 2500 + "x", _word(rng, "ACGT", 1500), _word(rng, low, 1022), _word(rng, low, 1023), _word(rng, low, 1024), _word(rng, low, 2500), _word(rng, "etaoin", 1500), _word(rng, "theandingr", 1500), _word(rng, "的一是不了人我在有他", 700)]
    c.cache.clear()
    for t in texts:
        assert c.encode([t]) == [u32(ref.encode_ordinary(t))], t[:20]
    with pytest.raises(ValueError):
        c.decode([u32([len(c.ranks) + 5])])


@pytest.mark.parametrize(("words", "letters"), [(3000, 150), (12_000, 60), (30_000, 40)])
def test_bpe_of_many_long_words(spark, words, letters):
    """Words that no vocabulary holds, within one document and spread over many."""
    ref, rng = reference(), np.random.default_rng(words)
    own = [_word(rng, "abcdefghijklmnopqrstuvwxyz", letters) for _ in range(words)]
    texts = [" ".join(own), *(" ".join(own[i::8]) for i in range(8))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = {r["doc_id"]: r for r in encode_decode(df, "text", P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert bytes(out[i]["ids"]) == u32(ref.encode_ordinary(t)) and bytes(out[i]["decoded"]) == t.encode()


def test_bpe_rounds_fit_the_memory_of_a_query():
    """Many long pieces, a document of many tokens, and one of the longest token."""
    c = codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(4)
    text = " ".join("".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (8000, 100)))
    c.cache.clear()
    assert c.encode([text]) == [u32(reference().encode_ordinary(text))]
    longest = max(c.ranks, key=len)
    ids = [u32([]), u32(rng.integers(0, len(c.ranks), 5_000_000)), u32([7]), u32([c.ranks[longest]] * 700_000), u32([])]
    chars = {k: t for t, k in c.ranks.items()}
    assert [hashlib.sha256(x).digest() for x in c.decode_all(ids)] == [hashlib.sha256(b"".join(map(chars.__getitem__, np.frombuffer(b, np.uint32).tolist()))).digest() for b in ids]


def brute_tokens(rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, u32(ids)))
        start += len(ids)
    return out


def test_token_files(spark):
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (-(1 << 63), "the least id"), (7, "again"), (7, "Again, again.")]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int").repartition(3)
    folder = token_store.write_tokens(df, "doc_id", "text", P.path("word_bpe_49k.json"), 2)
    got = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in token_store.read_tokens(spark, folder).collect())
    assert [(d, s, i) for s, d, i in got] == brute_tokens(rows)
    # short access to one document, and a refused dictionary
    fs, path = filesystem(folder)
    name = spark.read.parquet(f"{folder}/manifest").first()["file"]
    dictionary = fs.open_input_file(f"{path}/dictionary.zdict").read()
    r = token_store.FileReader(fs, f"{path}/{name}", dictionary)
    assert r.read(len(r) - 1) == list(r)[-1]
    with pytest.raises(ValueError):
        token_store.FileReader(fs, f"{path}/{name}", b"other")
    empty = token_store.write_tokens(df.limit(0), "doc_id", "text", P.path("word_bpe_49k.json"), 2)
    assert token_store.read_tokens(spark, empty).count() == 0


def test_chunk_cache_is_exact():
    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_store.Tokenizer(P.path("word_bpe_49k.json"))
    texts = [t for t in TEXTS if t] + ["The THE the. The! é. É, ΣΑΣ. x́. don't. <|endoftext|> <|endoftext|>."]
    # small letters that compose where capitals do not, added tokens in other letters, marks after anything
    texts += ["H\u0331ouse J\u030c\u0331 T\u0308. E\u0301.", "A <|EndOfText|> b", "<|STARTOFTEXT|>", "a., B,. C!? ²,x É,é я.Я 9.9 _, it's, x\x1c,y d',s", "İ. ẞ! ǅ? Ω, ﬁ. K, Å! \u0958. क़, ſ.", "a.b,c!d?e ,.!? a ..,!"]
    assert own.lower and own.cut
    assert own.encode(texts) == [u32(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    rng = np.random.default_rng(8)
    odd = list("aAbBzZéÉßßſ.,!?'_-#9²٣ \t\n\x0b\x1c\u00a0\u2028\u0301\u0331\u0345ǅΣςİ…<|>") + ["<|endoftext|>", "'s", "'LL", "Ab", "ing"]
    texts = ["".join(rng.choice(odd, rng.integers(1, 40))) for _ in range(1500)]
    assert own.encode(texts) == [u32(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_letters_compose_with_common_marks_only():
    """What lets texts without such marks be lower-cased before they are normalized."""
    pairs = [unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1)]
    second = {int(p[1], 16) for p in pairs if len(p) == 2 and not p[0].startswith("<") and int(p[0], 16) < 128}
    assert second and all(token_store._COMBINING.match(chr(c)) for c in second)
    letters = [chr(c) for c in range(0x300) if re.match(f"[{token_store._LETTERS}]", chr(c))]
    assert len(letters) > 400 and all(unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c.lower().isalpha() for c in letters)


def test_warc_round_trip(spark):
    big, small = "<p>é" + "x" * 200, "tiny"
    rows = [(5, "http://a/ b", big), (3, None, big), (9, "u", big), (4, "u", small), (6, "u", small), (7, "u", None), (8, "u", ""), (None, "u", big), (None, "u", "lone" * 50), (11, "u", "y" * 300_000), (3, None, big)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(4)
    folder = warc.write_warc(df, "page_id", "url", "html")
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows)
    by = {}
    for i, u, h in rows:
        first = 3 if h == big else None
        by.setdefault(i, []).append(("revisit" if first and i != first else "response", first if i != first else None, hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())))
    seen = {}
    for r in got:
        seen.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"]))
        if r["record_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
    assert {k: sorted(v, key=str) for k, v in seen.items()} == {k: sorted(v, key=str) for k, v in by.items()}
    # any gzip reader can read an archive
    fs, path = filesystem(folder)
    name = spark.read.parquet(f"{folder}/manifest").first()["file"]
    assert gzip.decompress(fs.open_input_file(f"{path}/{name}").read()).startswith(b"WARC/1.1\r\n")
    assert warc.read_warc(spark, warc.write_warc(df.limit(0), "page_id", "url", "html")).count() == 0


def test_warc_refuses_damage():
    one, two = warc.record(1, "u", b"p" * 500), warc.record(2, "u", b"q" * 500)
    assert [r[0] for r in warc.read_stream(io.BytesIO(one + two))] == [1, 2]
    with pytest.raises(warc.BadRecord):
        list(warc.read_stream(io.BytesIO(one + two[:-5])))
    raw = gzip.decompress(one)
    for bad in (raw.replace(b"ppp", b"ppq", 1), raw.replace(b"WARC/1.1", b"HTTP/1.1"), raw[:-4], raw.replace(b"Content-Length", b"Content-Len", 2)):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(warc.BadRecord):
            list(warc.read_stream(io.BytesIO(z.compress(bad) + z.flush())))
    with pytest.raises(warc.BadRecord):
        list(warc.members(io.BytesIO(b"not gzip at all")))


def test_worker_caches_go_when_a_worker_rests(monkeypatch):
    monkeypatch.setattr(common, "IDLE_S", 0.2)
    one, two = {"a": 1}, {"b": 2}
    with common.cached("one", one.clear):
        assert one
    with common.cached("one", one.clear):
        time.sleep(0.5)
        assert one  # the worker had not rested for so long
    with common.cached("two", two.clear):
        assert two and not one
    time.sleep(0.5)
    assert not two


def test_a_worker_frees_what_other_operators_keep(spark):
    """Tasks of one operator after another in the same workers: the second's find the first's cache empty."""
    docs = spark.createDataFrame([(i, f"some text number {i} hereabouts") for i in range(40)], "doc_id long, text string").coalesce(1)
    encode_decode(docs, "text", P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count()
    sign(docs).count()

    def held(batches):
        from stratum.llm import byte_bpe, minhash

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"codecs": [len(byte_bpe._codecs)], "words": [len(minhash._words)]})

    encode_decode(docs, "text", P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).write.format("noop").mode("overwrite").save()
    sign(docs).write.format("noop").mode("overwrite").save()
    r = docs.mapInArrow(held, "codecs long, words long").collect()
    assert all(x["codecs"] == 0 for x in r)


def test_caches_look_up_new_keys_only():
    """What is asked for bounds the look-ups, not what the cache holds."""
    seen = []

    class Key(int):
        def __hash__(self):
            seen.append(self)
            return int.__hash__(self)

    cache = common.Generations()
    cache.update((Key(k), b"") for k in range(1000))
    cache.turn()
    cache.update((Key(k), b"") for k in range(1000, 2000))
    seen.clear()
    assert cache.unknown({1, 1001, 5000}) == {5000} and len(seen) <= 10


def test_token_words_by_the_model_alone(monkeypatch):
    """Words of small letters skip the library's other steps, words beside signs are cut from them; ids stay the library's."""
    path = P.path("word_bpe_49k.json")
    lib, tok = Tokenizer.from_file(path), token_store.Tokenizer(path)
    texts = ["anenly$$$ anenly&&& onlyer### \"quoted\" it's we'll x#1 $5 a$b a:b;c* 100% <|endoftext|> end<|endoftext|>a;", "Anenly anenlY İx ıy ſtop naïve é$$$ я$$$ é$$ á ab\x1ccd;\x1f$ $́ a$́ K$ ﬁ$", "q" * 3000 + "; " + "zq" * 50]
    assert tok.encode(texts) == [u32(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    sent = []
    monkeypatch.setattr(tok, "lib", type("Spy", (), {"encode_batch_fast": lambda _, x, **k: (sent.extend(x), lib.encode_batch_fast(x, **k))[1]})())
    got = tok.encode(["plainword otherword$$$ plainword&&&"])
    assert got == [u32(lib.encode("plainword otherword$$$ plainword&&&", add_special_tokens=False).ids)]
    assert not any("word" in x for x in sent)
