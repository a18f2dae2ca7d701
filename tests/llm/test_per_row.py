"""Operators that map rows: HTML extraction, quality, SentencePiece, token counts, language ID."""

import hashlib
import html
import random
import re

import public_tokenizers
import pytest
import sentencepiece

from rillstone.llm import html_extract, language_id, quality, sentencepiece_codec, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- HTML ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site, name</header>
<nav><ul><li><a href="/">menu</a></li></ul></nav><div class="ad">buy, this, now</div><div id="notice" class="cookie-notice">we use, cookies</div>
{}<aside><p>other, things, to, read and more of it</p></aside><form><p>sign, up</p><input><button>go</button></form>
<section id="comments"><p>first, comment, of a reader that is long enough to count</p></section><footer>&copy; all, rights</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p>First  <b>bold</b>, second,\n third &#233;&hellip;<br>next</p><p>Another paragraph, with more text, and <a href=x>one link</a>.<p>unclosed, one<ul><li>item one<li>item two</ul>"
TEXT = "A & B First bold, second, third é… next Another paragraph, with more text, and one link. unclosed, one item one item two"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div class='post-body'>{}</div></main>", "<div id='content'>{}</div>", "<div><div>{}</div></div>"])
def test_main_text(wrap):
    assert html_extract.main_text(PAGE.format(wrap.format(BODY))) == TEXT


@pytest.mark.parametrize("names", ["content has-sidebar", "site-content no-sidebar", "main-content-with-sidebar", "post type-post tag-news", "entry-content share-enabled", "elementor-widget-text-editor", "elementor-widget"])
@pytest.mark.parametrize("outside", ["", "<p>a line, outside</p>"])
def test_names_that_match_by_chance_keep_the_article(names, outside):
    body = BODY + "<p>A longer paragraph, with much more text, that tells the rest of it.</p>" * 8
    want = " ".join([TEXT, *["A longer paragraph, with much more text, that tells the rest of it."] * 8])
    got = html_extract.main_text(PAGE.format(f"{outside}<div class='{names}'>{body}</div>"))
    assert want in got and "reader" not in got and "cookies" not in got and "other, things" not in got


LONG = "<p>A longer paragraph, with much more text, that tells the rest of it.</p>" * 8
LONG_TEXT = " ".join(["A longer paragraph, with much more text, that tells the rest of it."] * 8)


@pytest.mark.parametrize("names", ["content with-sidebar", "post no-comments", "post comments-open"])
def test_modifiers_keep_the_article(names):
    assert html_extract.main_text(f"<body><div class='{names}'>{LONG}</div></body>") == LONG_TEXT


def test_score_decides():
    promo = "<div class=box><p>Buy one, get two, today.</p></div>"
    links = "<ul>" + "<li><a href=/x>another story of the week</a>" * 5 + "</ul>"
    assert html_extract.main_text(f"<body><main><article>{LONG}</article><div>{promo * 4}</div></main></body>") == LONG_TEXT
    assert html_extract.main_text(f"<body><main><div>{LONG}</div>{promo}</main></body>") == LONG_TEXT
    assert html_extract.main_text(f"<body><main><section>{LONG}</section><section>{LONG}</section></main></body>") == f"{LONG_TEXT} {LONG_TEXT}"
    assert html_extract.main_text(f"<body>{links}{LONG}{links}</body>") == LONG_TEXT
    assert html_extract.main_text(f"<body><div>{LONG}{links}</div></body>") == LONG_TEXT
    assert html_extract.main_text(f"<body><form action=/all><div>{LONG}</div><input><button>go</button></form></body>") == LONG_TEXT
    assert html_extract.main_text(f"<body><div>{LONG}</div><form><p>Sign up, now, please.</p></form></body>") == LONG_TEXT
    assert html_extract.main_text(f"<body><div><p>one, two, three</p></div><div><p>four, five, six</p></div></body>").startswith("one, two, three")


def test_links_of_running_text_stay():
    body = LONG + "<ul><li>see <a href=a>one</a>, which tells of many things<li>and <a href=b>two</a> as well</ul><p><a href=c>The source of it</a></p>"
    assert html_extract.main_text(f"<article>{body}</article>") == f"{LONG_TEXT} see one, which tells of many things and two as well The source of it"


def slow_points(page):
    """Points of the containers of a page by the rules, from the tree: text blocks give to their parent and half to its parent."""
    root = html_extract.parse(page)
    value = {}

    def text_of(n):
        return "".join(p if type(p) is str else text_of(p) for p in n.parts)

    def links_of(n):
        return len(text_of(n)) if n.tag == "a" else sum(links_of(p) for p in n.parts if type(p) is not str)

    def walk(n, up):
        if n.tag == "p":
            t = " ".join(text_of(n).split())
            points = (1 + t.count(",") + min(len(t) / 100, 3)) * (1 - links_of(n) / len(text_of(n)))
            for k, share in ((0, 1), (1, 0.5)):
                c = up[-1 - k] if len(up) > k else None
                if c is not None:
                    value[id(c)] = value.get(id(c), html_extract.BASE.get(c.tag, 0)) + share * points
        for p in n.parts:
            if type(p) is not str:
                walk(p, [*up, n])

    walk(root, [])
    order = [n for n in html_extract.nodes_of(root) if id(n) in value]
    return max(order, key=lambda n: value[id(n)] * (1 - (links_of(n) / len(text_of(n)) if text_of(n) else 0)))


@pytest.mark.parametrize("seed", range(8))
def test_best_container_by_brute_force(seed):
    rnd = random.Random(seed)

    def block(depth):
        if depth == 3 or rnd.random() < 0.4:
            return "<p>" + ", ".join(f"w{rnd.randrange(9)}" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 9))) + "</p>"
        return "<div>" + "".join(block(depth + 1) for _ in range(rnd.randint(1, 4))) + "</div>"

    page = "<html><body>" + "".join(f"<div>{block(1)}{block(1)}</div>" for _ in range(4)) + "</body></html>"
    best = slow_points(page)
    want = " ".join(html_extract.pieces(best))
    assert want in html_extract.main_text(page)


@pytest.mark.parametrize("name", ["sidebar", "sidebar-content", "related", "widget", "share", "tags", "comment-body"])
def test_named_boilerplate_stays_out(name):
    page = PAGE.format(f"<div id='content'>{BODY}</div><div class='{name}'><p>boiler, plate, of the side</p></div>")
    assert html_extract.main_text(page) == TEXT


def test_only_text_of_a_page_is_kept():
    assert html_extract.main_text("<div class='discussion'><p>the only, text</p></div>") == "the only, text"


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a, b", "a, b"), ("<script>x</script>", ""), ("<nav>x</nav>", ""), ("<article><p>x</p></article", "x"), ("</div></p>", ""), ("<!-- x", "")])
def test_odd_pages(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 50_000, '<a href="' * 20_000, "<p" * 50_000, "<!--" * 20_000, "<b>" * 20_000 + "x, y", "&" * 50_000, "<p a='" * 20_000])
def test_broken_pages_end(page):
    html_extract.main_text(page)


def test_pages_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in html_extract.op1_html_extract(spark, data).collect()}
    for r in pages.collect():
        own = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>|<!--.*?-->", "", own))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_pages_with_nulls(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "y"), (2, "u", "<p>a</p>", None), (2, "u", "<p>a</p>", None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(((r.page_id, r.text, r.n_chars) for r in got), key=str) == sorted([(1, "", 0), (None, "", 0), (2, "a", 1), (2, "a", 1)], key=str)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- quality ---------------------------------------------------------------------------------------------------------


def measured(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd_docs, docs):
    short = odd_docs.where("text is null or length(text) < 5000").select("doc_id", "text").union(docs.where("length(text) < 4000").select("doc_id", "text"))
    got = sorted((tuple(r) for r in quality.ledger(short).select("doc_id", *quality.MEASURES[:5]).collect()), key=str)
    assert got == sorted(((r.doc_id, *measured(r.text)) for r in short.collect()), key=str)


def test_quality_policies_and_ablations(spark, docs, no_docs):
    rows = quality.ledger(docs).cache()
    kept = quality.apply_policy(rows, 2)
    assert kept.where("kept").count() < docs.count()
    for r in quality.ablations(rows, 2).collect():
        bit = 1 << quality.RULES.index(r.rule)
        mask = quality.mask_of(quality.POLICIES[2])
        failed = [x.failed & mask for x in rows.select("failed").collect()]
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(f & bit > 0 for f in failed), sum(f == bit for f in failed), sum(f & ~bit == 0 for f in failed))
    assert quality.ledger(no_docs).count() == 0


def test_quality_query(spark, data):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = quality.op3_quality(spark, data).collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(r.kept for r in rows if labels.get(r.doc_id) == 0) < 0.2 * sum(v == 0 for v in labels.values())


# -- SentencePiece ---------------------------------------------------------------------------------------------------


def test_codec_equals_the_library(spark, odd_docs, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    both = odd_docs.select("doc_id", "text").union(docs.select("doc_id", "text"))
    want = []
    for r in both.collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, sentencepiece_codec.digests(both, PIECES).collect()), key=str) == sorted(want, key=str)
    assert all(r.decoded == sp.decode(r.ids) for r in sentencepiece_codec.encode_decode(odd_docs, PIECES).collect())


def test_chunk_table_can_overflow():
    codec = sentencepiece_codec.Codec(PIECES)
    codec.table.limit = 3
    sp = codec.sp
    for t in ["a b c d\ne", "f g", "a\n\nb", "▁ ▁", "x y z w v"]:
        ids, decoded = codec.run([t])
        assert ids[0].tolist() == sp.encode(t, add_bos=True, add_eos=True) and decoded == [sp.decode(sp.encode(t))]


def test_codec_without_rows(no_docs):
    assert sentencepiece_codec.digests(no_docs, PIECES).count() == 0


# -- token counts ----------------------------------------------------------------------------------------------------


def greedy(word, initial, continuing):
    at, n, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n, pieces = end, n + 1, continuing
    return n


def test_automaton_equals_greedy():
    rnd = random.Random(2)
    for _ in range(300):
        draw = lambda k: {"".join(rnd.choices("ab", k=rnd.randint(1, 4))) for _ in range(k)}
        initial, continuing = draw(3), draw(3)
        auto = token_counts.LongestMatch(initial, continuing)
        for _ in range(30):
            w = "".join(rnd.choices("ab", k=rnd.randint(0, 9)))
            assert auto.count(w) == greedy(w, initial, continuing)


def test_token_counts(spark, odd_docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    initial, continuing = {p[1:] for p in pieces if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]}, {p for p in pieces if "▁" not in p}
    short = odd_docs.where("text is null or length(text) < 5000")
    want = []
    for r in short.collect():
        n = [greedy(w, initial, continuing) for w in WORD.findall(r.text or "")]
        want.append((r.doc_id, len(n), sum(1 if x < 0 else x for x in n), sum(x < 0 for x in n)))
    assert sorted(map(tuple, token_counts.token_counts(short, PIECES).collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(no_docs, PIECES).count() == 0


def test_token_counts_query_reads_the_full_vocabulary(spark, odd_docs, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    more = [(20, "2024"), (21, "4111111111111111"), (22, "日本 中 한 ñandú ça ß"), (23, "a▁b ▁▁▁ the"), (24, "\ue123 ok")]
    short = odd_docs.where("text is null or length(text) < 5000").select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    short.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in short.collect():
        n = [greedy("▁" + w, pieces, pieces) for w in WORD.findall(r.text or "")]
        want.append((r.doc_id, len(n), sum(1 if x < 0 else x for x in n), sum(x < 0 for x in n)))
    got = list(map(tuple, token_counts.op7_token_counts(spark, str(tmp_path)).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(20, 1, 5, 0), (21, 1, 17, 0)} <= set(got) and {r[0]: r[3] for r in got}[22] == 0 and {r[0]: r[3] for r in got}[24] == 1


# -- language ID -----------------------------------------------------------------------------------------------------


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language_id.op10_language_id(spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in out) >= 0.98 * len(out)


def test_language_edge_cases(spark, odd_docs, no_docs):
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd_docs).collect()}
    assert {got[i] for i in (None, 1, 2, 3, 15)} == {"und"} and got[4] in ("en", "fr")
    assert language_id.identify(no_docs).count() == 0
    none = spark.createDataFrame([(1, None, "some text")], "doc_id long, lang string, text string")
    assert language_id.identify(none).first().lang_pred == "und"


def test_letters_and_marks():
    assert language_id.words_of("½²Ⅷ 12 _ ٣") == [] and language_id.words_of("हिन्दी में x²y") == ["हिन्दी", "में", "x", "y"]
    assert language_id.words_of("Plain ÇA va\u0301 𝒳y") == ["plain", "ça", "va\u0301", "𝒳y"]


def test_masks_and_popcounts_by_brute_force(spark):
    """Counts, membership and corrected popcounts of every text from the grams themselves."""
    import numpy as np

    rnd = random.Random(4)
    alphabets = {"aa": "abcdefg", "bb": "efghijk", "hi": "कखगहनदमिीे्"}
    text = lambda k, n: " ".join("".join(rnd.choices(alphabets[k], k=rnd.randint(1, 7))) for _ in range(n))
    rows = [(i, k, text(k, 60)) for i, k in enumerate(list(alphabets) * 12)] + [(90, "aa", "½ ²"), (91, None, text("aa", 5) + " " + text("bb", 5))]
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, lang string, text string")

    def grams(t):
        for w in language_id.EXACT.findall(t.lower()):
            yield from w
            yield from (p[j : j + n] for p in [f" {w} "] for n in language_id.ORDERS[1:] for j in range(len(p) - n + 1))

    counts = {}
    for i, k, t in [*rows, rows[0]]:
        if k and hashlib and __import__("zlib").crc32(str(i).encode()) % 4 != 2:
            for g in grams(t):
                counts.setdefault(k, {}).setdefault(g, 0)
                counts[k][g] += 1
    counts = {k: {g: n for g, n in c.items() if n >= 2} for k, c in counts.items()}
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    best = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    own = {k: {g for g, x in r.items() if x >= language_id.SHARE * best[g]} for k, r in rate.items()}
    for r in language_id.identify(df).collect():
        t = next(t for i, _, t in rows if i == r.doc_id)
        every = list(grams(t))
        hits = {k: sum(g in own[k] for g in every) for k in sorted(own)}  # filters this empty have next to no false positives
        if not every:
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            top = max(hits, key=hits.get)
            assert r.lang_pred == top and r.score == pytest.approx(hits[top] / sum(hits.values()), abs=0.02)


def test_predict_keeps_columns_of_any_name(spark, docs):
    clash = docs.selectExpr("doc_id", "lang", "text", "1 as c0", "2 as `__text`", "3 as `a b`")
    filters = language_id.fit(docs.selectExpr("doc_id as id", "lang", "text"))
    out = language_id.predict(clash, filters, clash.columns, replace_text=True)
    assert out.columns == [*clash.columns, "lang_pred", "score"]
    assert {r.doc_id: r.text for r in out.collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_filters_hold_all_grams_of_a_large_alphabet(spark):
    import numpy as np

    rnd = random.Random(5)
    words = ["".join(chr(0x4E00 + rnd.randrange(20_000)) for _ in range(40)) for _ in range(3000)]
    rows = [(i, "zh", " ".join(words[k] for k in range(i // 2 % 10, 3000, 10))) for i in range(20)] + [(i + 100, "en", "some plain words of text") for i in range(20)]
    filters = language_id.fit(spark.createDataFrame(rows, "id long, lang string, text string"))
    own = np.unique(np.concatenate([h[a:b] for h, begin, end in language_id.gram_hashes(words) for a, b in zip(begin, end, strict=True)]))
    assert len(own) > 300_000 and filters.hits(filters.masks(own))[:, filters.languages.index("zh")].all()
    assert filters.slots >= 8 * len(own) and filters.false_rates().max() < 0.03


def test_filters_hold_what_was_added():
    import numpy as np

    f = language_id.Filters([f"l{i}" for i in range(70)], slots=1 << 14)
    rnd = np.random.default_rng(1)
    grams = [rnd.integers(0, 1 << 63, 50).astype(np.uint64) for _ in range(70)]
    for i, g in enumerate(grams):
        f.add(i, g)
    assert all(f.hits(f.masks(g))[:, i].all() for i, g in enumerate(grams))
    assert f.hits(f.masks(rnd.integers(0, 1 << 63, 5000).astype(np.uint64))).mean() < 0.01


@pytest.mark.parametrize(("languages", "bits"), [(0, 8), (4, 8), (8, 8), (9, 16), (17, 32), (33, 64), (65, 64)])
def test_filters_are_as_wide_as_the_languages_need(languages, bits):
    import numpy as np

    f = language_id.Filters([f"l{i}" for i in range(languages)], slots=1 << 12)
    assert f.bits.itemsize * 8 == bits
    grams = np.random.default_rng(2).integers(0, 1 << 63, (languages, 9)).astype(np.uint64)
    for i, g in enumerate(grams):
        f.add(i, g)
    assert all(f.hits(f.masks(g))[:, i].all() for i, g in enumerate(grams))
    assert (f.false_rates() > 0).all() and len(f.false_rates()) == languages


def test_prediction_holds_small_slices_and_few_words(spark, docs, monkeypatch):
    """Two workers share an executor's memory with the JVM: about a megabyte of text at once."""
    seen = []
    monkeypatch.setattr(language_id, "map_text", lambda rows, column, fn, schema, setup=None, limit=4_000_000: seen.append((limit, setup().limit)) or rows.selectExpr("c0", "'' as p", "0D as s"))
    language_id.predict(docs, language_id.Filters(["a", "b"]), ["doc_id"])
    assert seen == [(1_000_000, 200_000)]
