"""Operators against brute force, exact round trips and the tokenizers' own libraries."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.llm import chat, decontaminate, html_extract, induced, kneser_ney, ngram_join, pieces, quality, sharding, suffix_dedup, tokens, urls

from . import brute

SCHEMA = "doc_id long, text string, key string, n int, id int"  # columns that clash with inner names


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], SCHEMA)


def near_copies(seed, n=150):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnopqrst") + r.choice("abcdef")
    bases = [[word() for _ in range(60)] for _ in range(5)]
    docs = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice("ABCDEFG")
        docs.append((i, " ".join(w[: r.randint(0, 60)] if r.random() < 0.3 else w)))
    return docs + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "word " * 30_000)]


@pytest.mark.parametrize("bounds", [(1 << 20, 1 << 22, 1000), (20, 2000, 5), (3, 1 << 22, 2), (1 << 20, 1000, 3)])
def test_components(spark, monkeypatch, bounds):
    for name, value in zip(("MANY", "PART_BYTES", "BLOCK"), bounds, strict=True):
        monkeypatch.setattr(ngram_join, name, value)
    docs = near_copies(bounds[0])
    want = brute.components(docs)
    rows = ngram_join.link_documents(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    sets = {d: brute.shingle_set(t) for d, t in docs}
    least = {s: min(d for d, t in sets.items() if t == s) for s in sets.values() if s}
    assert {r.doc_id: r.class_id for r in rows} == {d: least.get(s, d) for d, s in sets.items()}


def test_very_long_near_copies(spark):
    words = [f"w{i}" for i in range(1_000_000)]
    near = list(words)
    near[::40_000] = ["other"] * 25
    docs = [(3, " ".join(words)), (2, " ".join(near)), (1, " ".join(words[:700_000])), (0, "short " * 9)]
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(frame(spark, docs)).collect()}
    assert got == {3: 2, 2: 2, 1: 1, 0: 0}


def test_components_of_repeated_rows_and_of_none(spark):
    docs = [(7, "one two three four five six")] * 3 + [(None, "one two three four five six"), (3, None)]
    rows = ngram_join.link_documents(frame(spark, docs)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 7), (3, 3), (7, 7), (7, 7), (7, 7)]
    assert ngram_join.link_documents(frame(spark, docs).limit(0)).count() == 0


def passages(seed, n=60):
    r = random.Random(seed)
    letters = lambda k: "".join(r.choice("abcdeé ") for _ in range(k))
    shared = ["\0" * 90 + "q" * 20 + "\0" * 150] + [letters(r.choice([150, 199, 200, 201, 230, 400, 700])) for _ in range(9)]
    pick = lambda: r.choice([r.choice(shared), letters(r.randint(0, 150)), "ab" * r.randint(1, 130), "x" * r.randint(1, 260)])
    docs = [(i, "".join(pick() for _ in range(r.randint(0, 6)))) for i in range(n)]
    return docs + [(900, None), (901, ""), (902, docs[5][1]), (903, "q" * 201), (904, "z" * 200), (905, ("abc" * 80)[:203]), (906, ("lmn" * 80)[:202])]


@pytest.mark.parametrize(("group", "piece", "batch"), [(2000, 1024, 1 << 20), (1, 1024, 1 << 20), (4, 160, 300), (2000, 7, 250)])
def test_repeated_bytes(spark, monkeypatch, group, piece, batch):
    for name, value in (("GROUP", group), ("PIECE", piece), ("BATCH", batch)):
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = passages(group)
    want = brute.cut(docs)
    got = suffix_dedup.deduplicate(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all((r.kept_text is None) == (r.doc_id == 900) for r in got)


def test_one_passage_in_many_surroundings(spark, monkeypatch):
    """All contents of an anchor share it; contexts are cut until few share one."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 5)
    r = random.Random(12)
    letters = lambda k: "".join(r.choice("abcde") for _ in range(k))
    passage, heads = letters(260), [letters(60) for _ in range(3)]
    docs = [(i, letters(90) + r.choice(heads) + passage[(a := r.choice([0, 0, 30, 70])) : r.choice([190, 230, 260]) + a] + letters(90)) for i in range(70)]
    got = suffix_dedup.deduplicate(frame(spark, docs)).collect()
    want = brute.cut(docs)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == want and 10 < sum(x[1] > 0 for x in want.values())


def test_long_periodic_texts(spark):
    docs = [(1, "abcdefg" * 2_900_000), (2, "x" * 20_000_000), (3, "bcdefga" * 40), (4, "y" * 200)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.deduplicate(frame(spark, docs), texts=False).collect()}
    assert got == {1: (20_300_000, 20_300_000, 1), 2: (20_000_000, 20_000_000, 1), 3: (280, 280, 1), 4: (200, 0, 0)}


def test_repeated_rows_and_empty_table(spark):
    docs = [(1, "k" * 150 + "m" * 150)] * 2 + [(2, "short")]
    got = suffix_dedup.deduplicate(frame(spark, docs), texts=False).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 300), (1, 300), (2, 0)]
    assert suffix_dedup.deduplicate(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("few", [512, 0])
def test_suffix_arrays(monkeypatch, few):
    monkeypatch.setattr(induced, "FEW", few)
    r = random.Random(few)
    for _ in range(400):
        n, k = r.randint(1, 60), r.choice([1, 2, 3, 8])
        t = [r.randrange(k) for _ in range(n)]
        t = (t[:7] * 9)[:n] if r.random() < 0.3 else t
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert induced.suffix_array(np.array(t, np.int64), k).tolist() == want
        shared = induced.permuted_common_prefixes(bytes(t), np.array(want), 16)
        for a, b in zip(want, want[1:], strict=False):
            m = 0
            while b + m < len(t) and a + m < len(t) and t[a + m] == t[b + m]:
                m += 1
            assert shared[b] == min(m, 16)


def test_contamination(spark):
    r = random.Random(3)
    v = ["a", "b", "c", "Dé", "e1", "f"]
    say = lambda sizes, sep: sep.join(r.choice(v) for _ in range(r.choice(sizes)))
    docs = [(i, say([0, 1, 3, 12, 13, 14, 30, 80], " ")) for i in range(120)] + [(900, None), (901, "")]
    items = [(i, say([0, 2, 5, 7, 12, 13, 20], ", ")) for i in range(12)] + [(77, docs[9][1]), (None, docs[10][1]), (78, None), (5, docs[11][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, id string")
    want = brute.contaminated(docs, items)
    got = decontaminate.contamination(frame(spark, docs + docs[:5]), bench).collect()
    assert len(got) == len(docs) + 5
    for row in got:
        assert (row.n_words, row.n_hit, row["items"]) == want[row.doc_id]
    assert decontaminate.contamination(frame(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, docs).limit(0), bench).count() == 0


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "1", "²", "é", "中", "\U0001f600", "͸", "꟎", "<|endoftext|>", "<|endof", "!", "aaaa", "\x00", "\x1c", "\x85", "the", "ing"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(800)] + [(900, None), (901, ""), (902, "a" * 200_000), (903, " " * 5000), (904, "word and " * 150_000)]
    library = Tokenizer.from_file(path)
    want = {d: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for d, t in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(frame(spark, docs), path).collect()} == want
    assert tokens.count_tokens(frame(spark, docs).limit(0), path).count() == 0


def test_settled_characters_are_cut_as_the_library_cuts_them():
    import public_tokenizers

    c = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    for ch in map(chr, range(0x110000)):
        if not 0xD800 <= ord(ch) < 0xE000 and not c.odd.match(ch):
            s = f"a{ch}1{ch}!{ch}b {ch}"
            assert [s[i:j] for _, (i, j) in c.library.pre_tokenize_str(s)] == c.pattern.findall(s), hex(ord(ch))


def test_pieces(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    bits = ["a", "b", " ", "  ", "   ", "\n", "the", "ing", "1", "é", "ß", "中", "\U0001f600", "▁", "<s>", "</s>", "<0x41>", "<unk>", "!", "\x00", "​"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(800)] + [(900, None), (901, ""), (902, " " * 777), (903, "long " * 100_000)]
    for row in pieces.encode_documents(frame(spark, docs), path, spans=True).collect():
        text = dict(docs)[row.doc_id] or ""
        assert row.ids == library.encode(text, add_eos=True)
        assert row.decoded == library.decode(row.ids) and row.round_trip == (row.decoded == text)
        assert row.starts[0] == 0 and row.starts[1:] == row.ends[:-1] and row.ends[-1] == len(text.encode())
    enc = pieces.encoder(path)
    for _ in range(500):
        ids = [r.choice([1, 2, 0, 259, *range(3, 400), r.randint(3, 31_999)]) for _ in range(r.randint(0, 12))]
        assert enc.decode(ids) == library.decode(ids)


def double_array(keys: dict[bytes, bytes]) -> bytes:
    """A compiled character map, laid out the plain way."""
    import struct

    texts, at = b"", {}
    for k, v in keys.items():
        at[k] = len(texts)
        texts += v + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def place(prefix: bytes, node: int) -> None:
        after = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        base = next(b for b in range(1, 4000) if b not in bases and all((b ^ c) not in used for c in after + [0] * leaf))
        bases.add(base)
        units[node] |= (base ^ node) << 10 | (256 if leaf else 0)
        if leaf:
            used.add(base)
            units[base] = at[prefix] | 1 << 31
        used.update(base ^ c for c in after)
        units.update((base ^ c, c) for c in after)
        for c in after:
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    size = (max(units) | 255) + 1
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + texts


def test_character_map_takes_the_longest_prefix():
    spec = type("Spec", (), {"precompiled_charsmap": double_array({b"a": b"x", b"ab": b"yz", "é".encode(): b"e", b"\t": b" "}), "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True})
    text, source = pieces.Normalizer(spec)(" cab\t\taé ")
    assert text == "▁cyz▁xe"
    assert source.tolist() == [1, 1, 1, 1, 2, 2, 4, 4, 4, 6, 7, 10]


def test_base_counts(spark):
    r = random.Random(4)
    docs = [(i, "".join(r.choice(["a b c d e f g h ", "x ", "é|", "\n", "# ", "same line\n", " "]) for _ in range(r.randint(0, 40)))) for i in range(150)] + [(900, None), (901, "")]
    rows = quality.judge(frame(spark, docs).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))).collect()
    assert len(rows) == len(docs)
    for row in rows:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute.base(dict(docs)[row.doc_id])
        assert row.base_failed == (row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words)
        assert not (row.base_failed and row.kept)
    assert quality.judge(frame(spark, docs).limit(0).withColumn("lang", F.lit("en"))).count() == 0


def test_model_keeps_every_ngram(spark):
    r = random.Random(6)
    words = {lang: ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(1, 9))) for _ in range(3000)] for lang in ("en", "fr", None, "lang4020", "lang4068")}
    df = spark.createDataFrame([(lang, " ".join(w)) for lang, w in words.items()], "lang string, t string")
    numbers = kneser_ney.languages(df, "lang")
    assert len(set(numbers.values())) == 5
    want = set()
    for lang, own in words.items():
        data = f" {' '.join(own)} ".encode()
        for end in range(2, len(data) + 1):
            want.update((numbers[lang or ""], data[max(0, end - o) : end]) for o in range(1, kneser_ney.ORDER + 1) if end >= o)
    model = kneser_ney.Model.collected(*kneser_ney.model_rows(kneser_ney.count_ngrams(df, "t", "lang", numbers)))
    keys = model.alphas[0]
    assert len(want) > 30_000 and len(set(keys.tolist())) == len(keys)
    named = {(k >> 43, bytes(reversed((k & ((1 << 40) - 1)).to_bytes(5, "little")[: k >> 40 & 7]))) for k in keys.tolist()}
    assert named == want
    text = " ".join(words["en"]).encode()
    assert abs(kneser_ney.Known(model).nll(numbers["en"], [text])[0] - model.nll(numbers["en"], [text])[0]) < 0.01


def test_quality_on_held_labels(spark):
    d = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{d}/documents.parquet"))
    known = judged.where("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    good = known.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).collect()[0][0]
    bad = known.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).collect()[0][0]
    assert good > 0.99 and bad < 0.8


def test_quality_rejects_words_out_of_order(spark):
    d = "/root/testdata/sf0.1"
    judged = quality.judge(spark.read.parquet(f"{d}/documents.parquet"))
    known = judged.where("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    kept = {r.quality: (r.kept, r.n) for r in known.groupBy("quality").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    print("good kept, all", kept[1], "bad kept, all", kept[0])
    assert kept[1][0] > 0.995 * kept[1][1] and kept[0][0] < 0.4 * kept[0][1]


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[ASST] ", "[SYS]", "[ROLE:", "\\", "\n", "é", " ", "] ", "ok", "<\\s>", "[\\INST]"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None, "a]b"]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for c in range(60) for t in range(r.randint(1, 5))]
    rows += [(1, 0, "user", "twice"), (1, 0, "user", "twice"), (None, 0, "user", "no id"), (500, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, source string")
    out = chat.format_conversations(df).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_spans"))).collect()
    assert {x.conv_id for x in out} == {x[0] for x in rows}
    for row in out:
        own = sorted((x for x in rows if x[0] == row.conv_id), key=lambda x: (x[1], x[2] or "", x[3] or ""))
        assert row.round_trip and [(t.role, t.text) for t in row.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert row.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def extracted(spark, rows):
    df = spark.createDataFrame([(*x, "n") for x in rows], "page_id long, url string, html string, host string")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows)
    return {r.page_id: r.text for r in got}, {r.page_id: r.induced for r in got}


def test_extraction_of_single_pages(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><header>top</header><article><h1>A &amp; b</h1><p>one <b>two\n three<p>four&nbsp;&lt;i&gt;<ul><li>five<li>six</ul><footer>foot</footer><div class='comments'><p>me too</p></div><script>var a='</p>'</script></article><aside>side</aside></body>"
    wide = "<body><div class='page with-sidebar'><article class='post has-comments'><p>kept</p><div class='comments'><article class=comment>no</article></div></article><div class=sidebar><article class='related'><p>no</p></article></div><section id=comments><article><p>no</article></section></div>"
    rows = [(50, None, None), (51, "http://q.com", "plain  text &amp; more"), (52, "http://q.com", ""), (53, "http://z.org", page), (53, "http://z.org", page), (54, "http://y.org", wide)]
    rows += [(60, "http://a.org", "<article><div class='share of wealth'>first</div><div class='notice-of-award'>second</div><div class='cookie-notice'>no</div><div class='social-security'>third</div></article>")]
    rows += [(61, "http://b.org", "<article role='a\x1fb;c 1 div'><p>one</p><p class='x\x1fy'>two</p></article>"), (62, "http://c.org", "<article><p>one</p><a href=\"x>two</a><p class='y>three</p></article>")]
    rows += [(63, "http://d.org", "<article>" + "<div>" * 20_000 + "deep" + "</div>" * 20_000 + "<p>long</p>" * 20_000 + "</table>" * 20_000 + "</article>")]
    texts, induced = extracted(spark, rows)
    assert texts[53] == "A & b\none two three\nfour <i>\nfive\nsix"
    assert texts[54] == "kept"
    assert (texts[50], texts[51], texts[52]) == ("", "plain text & more", "")
    assert texts[60] == "first\nsecond\nthird"
    assert texts[61] == "one\ntwo" and texts[62] == "one\ntwo\nthree"
    assert texts[63] == "deep" + "\nlong" * 20_000
    assert not any(induced.values())
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_say_what_content_is(spark):
    """Without an article, and with one, the same parts of a host's pages are content."""
    bare = lambda i, tag: f"<body><div class=top>Site</div><{tag} id=x><h1>Title {i}</h1><p>Paragraph {i} is long enough here, and longer than that</p><div class=box>Follow us for more</div><p>second {7 * i} words</p></{tag}><div>legal text</div><form>f{i}</form><div class=low><a href=/>more {i} links</a></div></body>"
    rows = [(100 * k + i, f"http://h{k}.com/{i}", bare(i, tag)) for k, tag in enumerate(("div", "article", "section")) for i in range(9)]
    rows += [(900 + i, "http://h1.com/again", bare(0, "article")) for i in range(40)]
    texts, induced = extracted(spark, rows)
    says = lambda i: f"Title {i}\nParagraph {i} is long enough here, and longer than that\nsecond {7 * i} words"
    assert all(texts[100 * k + i] == says(i) for k in range(3) for i in range(9)) and all(induced.values())
    assert all(texts[900 + i] == says(0) for i in range(40))


def test_induction_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    fixed = [say(4) for _ in range(6)]

    def page(host):
        parts = [f"<div class=top>{fixed[host]}</div>", f"<nav><ul><li><a>{say(2)}</a></ul></nav>"]
        inner = [f"<h1>{say(3)}</h1>"] + [r.choice([f"<p>{say(9)}", f"<p>{say(9)}", f"<p>{fixed[5]}", f"<ul><li>{say(3)}<li>{say(2)}</ul>", f"<div class=ads>{say(5)}</div>", f"<blockquote><p>{say(7)}</p></blockquote>"]) for _ in range(r.randint(3, 6))]
        parts.append(f"<div class=story>{''.join(inner)}</div>")
        parts += [f"<div class=other>{say(3)}</div>"] * r.randint(0, 1) + [f"<footer>{fixed[4]}</footer>"]
        return "<body>" + "".join(parts) + "</body>"

    rows = []
    for host in range(4):
        own = [page(host) for _ in range(14)]
        own += [own[0]] * 5
        first = html_extract.to_text(html_extract.parse(own[0])[0])
        own += [h for h in (page(host) for _ in range(400)) if html_extract.to_text(html_extract.parse(h)[0]) == first][:12]
        rows += [(1000 * host + i, f"http://host{host}.org/{i}", h) for i, h in enumerate(own)]
    texts, induced = extracted(spark, rows)
    for host in range(4):
        want = brute.induced([(i, h) for i, _, h in rows if i // 1000 == host])
        for i, text in want.items():
            assert induced[i] == (text is not None) and (text is None or texts[i] == text)
    assert sum(induced.values()) > 0.9 * len(rows)


def test_tree_matching_against_the_textbook():
    r = random.Random(2)

    def tree():
        out = [(0, "#")]
        for _ in range(r.randint(0, 9)):
            depth = r.randint(1, out[-1][0] + 1)
            out.append((depth, r.choice("abcde")))
        keep = []  # siblings of different labels, as the parser makes them
        for i, above in enumerate(html_extract.parents(out)):
            if i == 0 or above in keep and not any(out[k][1] == out[i][1] and html_extract.parents(out)[k] == above for k in keep):
                keep.append(i)
        return [out[i] for i in keep]

    for _ in range(500):
        one, two = tree(), tree()
        found = html_extract.match_trees(one, two)
        assert len(found) == brute.tree_match(one, two)[0]
        above_one, above_two = html_extract.parents(one), html_extract.parents(two)
        rising = sorted(found.items())
        assert all(one[i][1] == two[j][1] and (i == 0 or found[above_one[i]] == above_two[j]) for i, j in rising)
        for i, j in rising:
            assert all((k < i) == (m < j) for k, m in rising if above_one[k] == above_one[i])


def test_wrappers_need_no_names(spark):
    """Articles without their tag, and names that say nothing: what varies over a host's pages decides."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    names: dict[str, str] = {}
    rename = lambda m: f'{m[1]}="{names.setdefault(m[0].lower(), "q" + "abcdefghij"[len(names) % 10] * (1 + len(names) // 10))}"'
    plain = lambda html: re.sub(r"\b(class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", rename, re.sub(r"<(/?)(article|main)\b", r"<\1div", html))
    rows = [(r.page_id, r.url, plain(r.html)) for r in pages.collect()]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    decided = [r for r in got if r.induced]
    assert len(decided) > 0.8 * len(want) and sum(r.text == want[r.page_id] for r in decided) >= 0.9 * len(decided)


def test_sections_of_an_article_stay_whatever_their_name():
    for name in ("search", "related", "social", "reply", "hidden"):
        order, found = html_extract.parse(f"<body><article><p>one two three</p><section class={name}><p>four five</p></section></article></body>")
        kept = html_extract.alone(order, found, html_extract.declared_parts(order))
        assert [t for node, t, _ in found if node in kept] == ["one two three", "four five"], name


def test_extraction_counts_different_pages(spark):
    page = lambda i: f"<body><div class=top>Site</div><div id=x><h1>Title {i}</h1><p>Paragraph {i} is long enough here, and has more words than the title</p></div><div class=end>legal text</div></body>"
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(5)] + [(100 + i, f"http://h.com/c{i}", page(0)) for i in range(20)] + [(200 + i, f"http://two.com/{i}", page(0)) for i in range(2)]
    texts, induced = extracted(spark, rows)
    says = lambda i: f"Title {i}\nParagraph {i} is long enough here, and has more words than the title"
    assert all(texts[i] == says(i) for i in range(5)) and all(texts[100 + i] == says(0) for i in range(20))
    assert all(texts[200 + i] == says(0) and not induced[200 + i] for i in range(2))


def test_extraction_leaves_template_out_of_articles(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><div class=box>Follow us for more</div><p>Paragraph {i} is long</p><p>Written by the staff of this site</p></article></body>"
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(5)] + [(9, "http://h.com/9", page(0)), (10, "http://one.com/", page(10))]
    texts, _ = extracted(spark, rows)
    assert all(texts[i] == f"Title {i}\nParagraph {i} is long" for i in range(5)) and texts[9] == texts[0]
    assert texts[10] == "Title 10\nFollow us for more\nParagraph 10 is long\nWritten by the staff of this site"


def test_url_rules_and_models(spark):
    said = {
        "http://WWW.Example.org/es/1?x": ("www.example.org", "/es/1", "example.org/es/", "block"), "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://a.org/x": ("a.org", "/x", "org/", "allow"), "http://a.org": ("a.org", "", None, None), "http://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"),
        "http://a.com/de/1": ("a.com", "/de/1", "com/de/", "block"), "x.org/1": ("", "", None, None), "http://borg/1": ("borg", "/1", None, None), "a://b?c://d.org/": ("b", "", None, None),
    }
    rows = [(i, u) for i, u in enumerate(said)] + [(100, None), (101, "")] + [(200 + i, f"http://site{i}.com/{'de' if i % 2 else 'fr'}/{'spam-win' if i % 2 else 'news'}-{i}") for i in range(60)]
    rows += [(300, "http://x.net/en/spam-win-3"), (301, "http://x.net/en/news-4")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, g int")).collect()}
    for i, (host, path, rule, verdict) in enumerate(said.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict
    assert (got[100].host, got[100].path) == ("", "")
    assert (got[300].verdict, got[301].verdict) == ("block", "allow")
    none = urls.filter_urls(spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")).collect()
    assert none[0].verdict == "allow"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_shards(spark):
    docs = [(i, f"text {i % 90}") for i in range(400)] + [(500 + i, "hot") for i in range(300)] + [(900, None), (901, ""), (902, "é"), (902, "é"), (903, "long " * 200_000)]
    got = sharding.shard_documents(frame(spark, docs), shards=7).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(7)]
    assert len(got) == len(docs) and max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    text = dict(docs)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    split = lambda rows: {t for t in text.values() if t != "hot" and len({r.shard for r in rows if text.get(r.doc_id, "") == t}) > 1}
    # linked documents fill all shards: nothing moves where nobody goes the other way
    assert len(split(got)) <= 40
    roomy = sharding.shard_documents(frame(spark, docs + [(1000 + i, f"alone {i}") for i in range(300)]), shards=7).collect()
    assert len({r.shard for r in roomy if text.get(r.doc_id) == "hot"}) <= 4 and len(split(roomy)) <= 5
    assert all(r.wish is None for r in got if r.doc_id in (900, 901, 903))
    assert sharding.shard_documents(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize(("hubs", "rounds"), [(1, 6), (2, 6), (1, 0)])
def test_propagation_against_plain_version(spark, hubs, rounds):
    r = random.Random(hubs)
    links = [(n, n % 60 if n < 300 else 777 if n < 460 else 1000 + n // 9) for n in range(700)]
    links += [(n, 5000 + r.randrange(40)) for n in range(700)] * (hubs > 1)
    quota = sharding.quotas(760, 6)
    want, seen = brute.propagated(links, quota.tolist(), rounds)
    df = spark.createDataFrame(links, "node long, hub long")
    state = sharding.propagate(df, quota, rounds)
    assert dict(map(tuple, state.collect())) == want
    assert all(n <= quota[s] for rows in seen for s, n in enumerate(rows))
    counts = [sum(s == k for s in want.values()) for k in range(6)]
    assert all(n <= q for n, q in zip(counts, quota.tolist(), strict=True))
    if rounds:
        before = sharding.strays(df, sharding.propagate(df, quota, 0))
        assert sharding.strays(df, state) < (0.35 if hubs == 1 else 0.75) * before


def test_grants_keep_the_quota():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 7))
        asked = r.integers(0, 9, (n, n)) * (r.random((n, n)) < 0.5)
        np.fill_diagonal(asked, 0)
        quota = r.integers(20, 60, n)
        rows = np.minimum(asked.sum(axis=1) + r.integers(0, 9, n), quota)
        asked = np.minimum(asked, np.maximum(rows // max(1, n), 0)[:, None])
        moves = sharding.granted(asked, rows, quota)
        after = rows + moves.sum(axis=0) - moves.sum(axis=1)
        assert (moves >= 0).all() and (moves <= asked).all() and (after <= quota).all()
        assert (moves >= np.minimum(asked, asked.T)).all()
        full = after >= quota
        assert not ((asked - moves)[:, ~full] > 0).any()


def test_kneser_ney_against_plain_version(spark):
    r = random.Random(11)
    texts = {lang: [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))) for _ in range(40)] for lang, letters in (("en", "abcd"), ("fr", "aéx"))}
    rows = [(lang, t) for lang, own in texts.items() for t in own] + [("en", texts["en"][0])] * 3 + [("en", None), ("fr", " \n")]
    df = spark.createDataFrame(rows, "lang string, t string")
    numbers = kneser_ney.languages(df, "lang")
    model = kneser_ney.Model.collected(*kneser_ney.model_rows(kneser_ney.count_ngrams(df, "t", "lang", numbers)))
    known = kneser_ney.Known(model)
    for lang in texts:
        own = [f" {t} ".encode() for x, t in rows if x == lang and t and t.strip()]
        plain = brute.kneser_ney(own)
        for t in texts[lang][:15]:
            want = plain(f" {t} ".encode())
            assert abs(known.nll(numbers[lang], [t.encode()])[0] - want) < 1e-5 * max(1, want)


def test_url_scores_against_plain_version(spark):
    r = random.Random(12)
    made = [f"http://site{r.randrange(9)}.com/{r.choice(['de', 'fr', 'en'])}/{''.join(r.choice('abcd-/') for _ in range(r.randint(0, 8)))}" for _ in range(80)]
    made += made[:3] + ["http://x.org/" + "long/" * 4000]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = {x.page_id: x for x in urls.filter_urls(df).collect()}
    models = [brute.witten_bell([f" {u} ".encode() for i, u in enumerate(made) if got[i].rule and dict(urls.RULES)[got[i].rule] == says]) for says in ("block", "allow")]
    for i, u in enumerate(made):
        t = f" {u} ".encode()
        assert abs((models[0](t) - models[1](t)) / (len(t) - 1) - got[i].score) < 1e-4
    open_ = [x for x in got.values() if x.rule is None]
    least = min((x.score for x in open_ if x.verdict == "allow"), default=None)
    assert open_ and (least is None or all(x.score < least for x in open_ if x.verdict == "block"))


def test_registered_encoding_against_the_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = [(1, "Hello  world\n"), (2, None), (3, ""), (4, "ünïcode 中文 ▁ x"), (4, "ünïcode 中文 ▁ x"), (5, "a " * 30_000)]
    rows = pieces.encode_digests(frame(spark, docs), path).collect()
    assert len(rows) == len(docs)
    for row in rows:
        text = dict(docs)[row.doc_id] or ""
        ids = library.encode(text, add_eos=True)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids)))
        assert row.span_bytes == len(text.encode())


def test_common_chunks_are_merged_once(monkeypatch):
    """A worker that knows too many chunks forgets those less used, and the pieces are the library's all the while."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(pieces, "MEMO", 60)
    merged, merge_all = [], pieces.merge_all
    monkeypatch.setattr(pieces, "merge_all", lambda symbols, sizes, table: merged.append(len(sizes)) or merge_all(symbols, sizes, table))
    enc = pieces.Encoder(path)
    common, r = [f"often{c}" for c in "abcdefghij"], random.Random(5)
    n = 0
    for k in range(40):
        texts = [" ".join([*common, *(f"{r.getrandbits(40):x}" for _ in range(7)), "\n", "x\0y", "中"[k % 2 :], *["  "] * (k % 3)]) for _ in range(2)] + [None, "", "▁" * k]
        n += 14
        coded = enc.encode(texts)
        ids, bounds = coded[0], coded[-1]
        for t, a, b, said, back in zip(texts, bounds, bounds[1:], enc.in_decimal(ids, bounds), enc.decode_all(ids, bounds), strict=False):
            expected = library.encode(t or "", add_eos=True)
            assert ids[a:b].tolist() == expected and said.decode() == " ".join(map(str, expected)) and back == library.decode(expected)
        assert len(enc.place) <= 60 + 40
    assert sum(merged) < n + 150  # 560 that are new, and not the common ones again and again
