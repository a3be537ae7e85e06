"""Every operator against its one-by-one version, on texts with all the awkward cases."""

import math
import random
import time

import brute
import pytest
from samples import as_documents, corpus, rows, words

from boxloom.llm import (
    classifier, decontamination, extraction, graph, jaccard, licenses, mixing, rules, scoring, substrings, warc,
)


def same(found, expected):
    assert found == sorted(expected, key=repr)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(documents, texts, k, percent):
    found = rows(jaccard.jaccard_components(documents, k, percent), "doc_id", "n_shingles", "component_id")
    same(found, brute.components(texts, k, percent))


def test_jaccard_family_of_unlinked_copies(spark):
    """Copies at a distance just beyond the threshold, some links among them."""
    rng = random.Random(5)
    base = words(rng, 120, 10**6)
    family = [(0, " ".join(base))]
    for i in range(1, 90):
        own = list(base)
        for at in rng.sample(range(120), rng.choice((1, 2, 3, 4))):
            own[at] = f"n{i}_{at}"
        family.append((i, " ".join(own)))
    found = rows(jaccard.jaccard_components(as_documents(spark, family)), "doc_id", "n_shingles", "component_id")
    same(found, brute.components(family, 3, 90))


def test_one_of_each(documents, texts):
    kept = jaccard.one_of_each(documents)
    assert kept.columns == documents.columns
    distinct = sorted(set(texts), key=lambda row: (row[0] is None, row[0] or 0))
    groups = {}
    for row, (_, _, c) in zip(distinct, brute.components([(i, t) for i, (_, t) in enumerate(distinct)], 5, 80), strict=True):
        groups.setdefault(c, []).append(row)
    found = rows(kept, "doc_id", "text")
    assert len(found) == len(groups)
    for group in groups.values():  # rows of the smallest id are told apart by a hash
        assert len([row for row in group if row in found]) == 1
        assert [row[0] for row in group if row in found] == [group[0][0]]


def test_stages_take_columns_of_any_name(spark, documents):
    names = ["_id", "_d1", "_d2", "_kept", "_key", "_KEY", "id", "key"]
    names = [n for i, n in enumerate(names) if n.lower() not in {m.lower() for m in names[:i]}]
    more = documents
    for name in names:
        more = more.withColumn(name, documents["doc_id"] + 7)
    items = spark.createDataFrame([("b", "a b c")], "item_id string, text string")
    for stage in (jaccard.one_of_each, substrings.without_repeats, lambda df: decontamination.decontaminate(df, items)):
        found, plain = stage(more), stage(documents)
        assert found.columns == more.columns
        same(rows(found, "doc_id", "text"), rows(plain, "doc_id", "text"))
        assert found.filter("not (_id <=> doc_id + 7)").isEmpty()


def test_jaccard_plan_finds_every_linkable_pair_of_sizes():
    plan = jaccard.plan_for(3, 90)
    for a in range(1, 400):
        for b in range(a, 2 * a):
            if plan.overlap(a, b) <= a:
                class_of = [max(k for k, least in enumerate(plan.classes) if least <= n) for n in (a, b)]
                assert class_of[1] - class_of[0] in (0, 1)
                assert a + b - 2 * plan.overlap(a, b) < plan.parts[class_of[0]] - plan.spare[class_of[0]] or b <= plan.light


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100)], "a bigint, b bigint")
    assert rows(graph.components(links), "node", "component") == sorted([(i, 0) for i in range(41)] + [(99, 99), (100, 99)], key=repr)


PAGES = "page_id bigint, url string, html string, digest string, kept int"


def pages_of():
    rng = random.Random(3)
    long = " ".join(words(rng, 300))
    html = [None, "", "short", "short", long, long, long, "é" * 600, "é" * 600, long + "!", "x" * 400_000]
    return [(i, None if i == 2 else f"http://h/{i} \n?q=é", h) for i, h in enumerate(html)] + [(None, "u", long), (None, None, "z")]


def test_warc_round_trip(spark):
    data = pages_of()
    pages = spark.createDataFrame([(*p, "d", 1) for p in data], PAGES).repartition(2)
    found = rows(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same(found, brute.warc(data))


def test_warc_archive_is_read_record_by_record(spark, tmp_path):
    data = pages_of()
    archives = warc.write_archives(spark.createDataFrame([(*p, "d", 1) for p in data], PAGES).coalesce(1), f"file://{tmp_path}")
    listed = archives.collect()
    assert sum(a["records"] for a in listed) == len(data)
    read = {r["page_id"]: r["payload"] for r in warc.read_archives(archives, f"file://{tmp_path}").collect() if r["payload"] is not None}
    assert read[7] is None if 7 in read else True
    assert bytes(read[8]).decode() == "é" * 600 and bytes(read[0]) == b"" and len(read[10]) == 400_000
    for a in listed:
        with open(a["path"], "rb") as f:
            assert f.read(4) == b"\x5d\x2a\x4d\x18"


def test_warc_without_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_mixing(documents, texts):
    found = [r.asDict() for r in mixing.report(documents).collect()]
    assert sorted(((r["doc_id"], r["size"]) for r in found), key=repr) == sorted(((d, len(brute.spaced(t))) for d, t in texts), key=repr)
    whole = sum(r["size"] for r in found)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in found}
    assert math.isclose(sum(t for t, _ in targets.values()), 1.5 * whole)
    for name, (target, size) in targets.items():
        taken = sum(r["taken"] for r in found if r["source"] == name)
        assert abs(taken - target) <= 2 * mixing.BLOCK_WORDS + 0.02 * target and target <= 2 * size
    assert all(r["taken"] <= 2 * r["size"] for r in found)
    again = mixing.report(documents.repartition(5))
    assert rows(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in found), key=repr)


def test_mix_holds_the_texts_it_counts(documents, texts, tmp_path):
    found, shards = mixing.mix(documents, folder=f"{tmp_path}/mix")
    placed = [r.asDict() for r in found.collect()]
    order = ("shard", "place", "src", "pass", "block")
    slots = sorted((r.asDict() for r in shards.collect()), key=lambda r: [r[k] for k in order])
    quotas = {i: s.quota for i, s in enumerate(mixing.plan_sources(list({r["source"]: r["source_size"] for r in placed}.items())))}
    drawn = {i: [(r["pass"], r["block"]) for r in slots if r["src"] == i] for i in quotas}
    assert {i: len(d) for i, d in drawn.items()} == quotas and all(len(set(d)) == len(d) for d in drawn.values())
    lines: dict = {}
    known = {}
    for d, t in texts:
        known.setdefault((d, len(brute.spaced(t))), []).append(brute.spaced(t))
    at = {}
    for r in sorted(placed, key=lambda r: (r["src"], r["offset"], r["size"])):
        line = lines.setdefault(r["src"], [])
        assert r["offset"] == len(line)
        at[r["src"], r["offset"]] = r["size"]
        line += known[r["doc_id"], r["size"]].pop()
    for r in slots:
        first = r["block"] * mixing.BLOCK_WORDS
        assert r["text"].split(" ") == lines[r["src"]][first : first + mixing.BLOCK_WORDS]
        assert sum(p["n"] for p in r["parts"]) == len(r["text"].split(" "))
        for p in r["parts"]:
            start = max(first, p["offset"])
            assert p["n"] == min(first + mixing.BLOCK_WORDS, p["offset"] + at[r["src"], p["offset"]]) - start


def test_mixing_targets_are_shared_until_none_is_above():
    planned = mixing.plan_sources([("b", 100), ("a", 1000), (None, 10), ("B", 1000)])
    assert [(s.name, s.weight) for s in planned] == [("B", 3), ("a", 1), ("b", 2), (None, 3)]
    # 3165 words: None stops at 20, b at 200, then 3 : 1 would give B 2208.75, above 2000
    assert [round(s.target, 6) for s in planned] == [2000, 945, 200, 20]


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 10, 257):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(77).cast("bigint")).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


def test_scoring(documents, texts):
    found = rows(scoring.score(documents), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    expected = sorted(brute.base_scores(texts), key=repr)
    assert [r[:5] for r in found] == [e[:5] for e in expected]
    for r, e in zip(found, expected, strict=True):
        assert math.isclose(r[5], e[5], rel_tol=1e-9) and r[6] < 0 and math.isfinite(r[6])


def test_scoring_without_training_rows(spark):
    held = [(i, "some words") for i in range(200) if brute.base_scores([(i, "")])[0][1]]
    found = scoring.score(as_documents(spark, held)).collect()
    assert len(found) == len(held) and all(r["base_score"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in found)


def test_lattice_adds_all_segmentations():
    pieces = scoring.Pieces({"▁": -2.0, "▁a": -1.0, "a": -1.5, "b": -2.5, "ab": -3.0, "▁ab": -4.0}, (-9.0,) * 256, 3)
    paths = [(-4.0,), (-1.0, -2.5), (-2.0, -3.0), (-2.0, -1.5, -2.5)]
    assert math.isclose(scoring.lattice_log("ab", pieces), math.log(sum(math.exp(sum(p)) for p in paths)))
    into: dict = {}
    scoring.expected("ab", pieces, into)
    whole = sum(math.exp(sum(p)) for p in paths)
    assert math.isclose(into["▁ab"], math.exp(-4) / whole) and math.isclose(into["b"], (math.exp(-3.5) + math.exp(-6)) / whole)
    assert math.isclose(scoring.lattice_log("é", pieces), -2.0 - 18.0)


ITEMS = "item_id string, text string, row int, window string, n int"


def items_of(texts):
    whole = dict(texts)
    longest = brute.alnum(max((t for t in whole.values() if t), key=len))
    picked = [" ".join(longest[50:75]), " ".join(longest[60:70]), "W1 w2, w3!", "spam spam", "é", None, "...", " ".join(longest[100:125])]
    return [(None if i == 3 else str(i), t) for i, t in enumerate(picked)] + [("0", picked[0])]


def test_decontamination(spark, documents, texts):
    data = items_of(texts)
    items = spark.createDataFrame([(*i, 1, "w", 2) for i in data], ITEMS)
    found = decontamination.report(decontamination.contamination(documents, items))
    expected = brute.contamination(texts, data)
    same(rows(found, *found.columns), expected)
    kept = decontamination.decontaminate(documents, items)
    assert kept.columns == documents.columns
    same(rows(kept, "doc_id", "text"), [d for d, e in zip(texts, expected, strict=True) if not e[5]])


def test_decontamination_of_a_document_that_is_one_long_item(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    docs = as_documents(spark, [(1, text), (2, f"before {text} after"), (3, text[:300]), (4, "a b c")])
    items = spark.createDataFrame([("long", text), ("short", "a b c")], "item_id string, text string")
    found = rows(decontamination.contamination(docs, items), "doc_id", "n_words", "n_hit", "items")
    part = len(text[:300].split())
    hit = sum(w == v for w, v in zip(text[:300].split(), text.split(), strict=False))
    same(found, [(1, 20_000, 20_000, ["long"]), (2, 20_002, 20_000, ["long"]), (3, part, hit, ["long"]), (4, 3, 3, ["short"])])


def test_decontamination_without_items(spark, documents, texts):
    found = decontamination.report(decontamination.contamination(documents, spark.createDataFrame([], ITEMS)))
    same(rows(found, "doc_id", "n_hit"), [(d, 0) for d, _ in texts])


LABELS = "doc_id bigint, quality int, toxic int, row string, text string"


def labelled(spark, texts, extra=()):
    data = [(d, int(brute.statistics(t)[2] < 20), int(d % 13 == 0), "x", "y") for d, t in texts if d is not None]
    return spark.createDataFrame([*data, (None, 1, 0, "x", "y"), (5, None, 0, "x", "y"), *extra], LABELS)


def test_quality_rules(spark, documents, texts):
    found = rules.judge(documents, labelled(spark, texts))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(rows(found, *names), [(d, *brute.statistics(t)) for d, t in texts])
    assert found.filter("kept and base_failed").isEmpty()
    empty = rules.judge(documents, spark.createDataFrame([], LABELS))
    assert empty.filter("kept = base_failed").isEmpty()


def test_rules_cover_what_thresholds_can_tell():
    rng = random.Random(1)
    data = []
    for _ in range(600):
        row = {name: rng.random() for name in rules.FEATURES}
        data.append((row, row["symbol_share"] > 0.7 or (row["mean_word"] < 0.2 and row["upper_share"] > 0.5)))
    learned = rules.learn(data)
    assert 1 <= len(learned) <= rules.MOST_RULES
    wrong = sum(bad != any(all(c.holds(row) for c in rule) for rule in learned) for row, bad in data)
    assert wrong < 30
    assert rules.learn([(r, False) for r, _ in data]) == [] and rules.learn([]) == []


def test_rules_find_rare_junk_and_every_kind_of_it():
    """Junk in fewer rows than a fortieth, and more kinds than eight."""
    rng = random.Random(8)
    data = [({name: 0.0 for name in rules.FEATURES} | {"n_words": rng.random()}, False) for _ in range(2000)]
    for row, _ in data[:30]:
        row["symbol_share"] = 0.2 + rng.random()
    rare = [(row, k < 30) for k, (row, _) in enumerate(data)]
    rng.shuffle(rare)
    rejects = lambda learned, row: any(all(c.holds(row) for c in rule) for rule in learned)
    learned = rules.learn(rare)
    assert len(learned) == 1 and all(rejects(learned, row) == bad for row, bad in rare)
    kinds = [({name: 0.0 for name in rules.FEATURES} | {"n_words": k + rng.random() / 2}, k % 2 == 1) for k in range(25) for _ in range(100)]
    rng.shuffle(kinds)
    learned = rules.learn(kinds)
    assert len(learned) > 8 and all(rejects(learned, row) == bad for row, bad in kinds)


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(2)
    clean = [(i, " ".join(words(rng, 40, 500))) for i in range(2400)]
    data = [(i, t if i % 4 else t.replace(" ", rng.choice((" nasty ", " vile ")), 2)) for i, t in clean]
    docs = as_documents(spark, data)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "r", "t") for i in range(2000)], LABELS)
    found = {r["doc_id"]: r for r in classifier.classify(docs, labels).collect()}
    assert all(0 <= r["tail_probability"] <= 1 and 1 <= r["expected_grade"] <= 2 for r in found.values())
    held_out = [i for i in found if i >= 2000]
    assert sum(found[i]["kept"] != (i % 4 > 0) for i in held_out) <= 0.03 * len(held_out)
    accepted = classifier.accepted(docs, labels)
    assert accepted.columns == docs.columns
    assert {r["doc_id"] for r in accepted.collect()} == {i for i, r in found.items() if r["kept"]}


def test_classifier_takes_odd_texts(spark, documents, texts, nothing):
    assert classifier.classify(documents, labelled(spark, texts)).count() == len(texts)
    unlabelled = classifier.classify(documents, spark.createDataFrame([], LABELS))
    assert unlabelled.filter("kept and expected_grade is null").count() == len(texts)


def test_substring_dedup(documents, texts):
    found = rows(substrings.report(documents), "doc_id", "n_words", "n_removed", "kept_sha256")
    expected = brute.removals(texts)
    same(found, expected)
    kept = substrings.without_repeats(documents)
    assert kept.columns == documents.columns
    left = {(d, e[3]) for (d, _), e in zip(texts, expected, strict=True) if e[1] == 0 or e[2] < e[1]}
    assert {(r["doc_id"], brute.sha(" ".join(brute.spaced(r["text"])))) for r in kept.collect()} == left


def test_substring_dedup_of_long_and_periodic_texts(spark):
    rng = random.Random(9)
    line = words(rng, 7)
    data = [(1, " ".join(line * 30)), (2, " ".join(words(rng, 50) + line * 4)), (3, " ".join(line * 3)), (4, " ".join(line[:3] * 40))]
    data += [(10 + i, " ".join(words(rng, 3000, 3))) for i in range(3)]
    found = rows(substrings.report(as_documents(spark, data)), "doc_id", "n_words", "n_removed", "kept_sha256")
    same(found, brute.removals(data))


def test_extraction():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
        "<div id='cookie-notice'>We use cookies for a great many things as you know</div><main><article><h1>Title</h1>"
        "<p>First paragraph with text &amp; more &lt;here&gt;, long enough to count as content.<p>Short.<ul><li>one<li>two</ul>"
        "<div class='ad'>Buy this wonderful product today</div><p>Second <b>bold</b>text.\n\n And  so on.<br>Next.</article></main>"
        "<aside>Related stuff that goes on and on</aside><form><p>subscribe now</p></form>"
        "<section id='comments'><p>Nice article, I really liked this whole thing.</p></section><script>var a = '<p>no</p>';</script><footer>bye</footer>"
    )
    want = (
        "Title First paragraph with text & more <here>, long enough to count as content. Short. one two "
        "Second boldtext. And so on. Next."
    )
    assert extraction.main_text(page) == want
    assert [extraction.main_text(x) for x in (None, "", "bare", "<p>a<p>b", "<div><p>x</div>y", "<nav>z")] == ["", "", "bare", "a b", "x y", ""]


def test_extraction_inside_a_layout_wrapper():
    text = "A paragraph of the article that is long enough to count as content of the page."
    rest = "<nav><a href=x>Home</a></nav>", "<footer>bye</footer>"
    for wrapper in ("<div class='layout has-sidebar'>", "<section class='side-by-side'>", "<div id=nav-top><div class=no-share>"):
        for tag in ("article", "main", "main><article"):
            inner = f"<{tag}><p>{text}</p><div class=ad>Buy this wonderful product today</div></{tag.split('>')[0]}>"
            page = f"{rest[0]}{wrapper}{inner}<aside>Related stuff that goes on</aside>{rest[1]}"
            assert extraction.main_text(page) == text
    inside = f"<main><div class='layout has-sidebar'><article><p>{text}</p></article><div class=related><article>{text}</article></div></div></main>"
    assert extraction.main_text(inside) == text
    assert extraction.main_text(f"<main><p>{text}</p></main><div class=related><article>{text}</article></div>") == text
    assert extraction.main_text(f"<main><p>{text}</p><ol class=comment-list><li><article>{text}</article></ol></main>") == text


def test_extraction_keeps_short_parts_beside_long_ones():
    long, short = " ".join(["word"] * 1200), " ".join(["tiny"] * 120)
    parts = f"<section><p>{long}</p></section><section><p>{short}</p></section>"
    assert extraction.main_text(f"<article><h1>Title</h1>{parts}</article>") == f"Title {long} {short}"
    assert extraction.main_text(f"<div id=content>{parts}</div><footer>bye</footer>") == f"{long} {short}"
    more = "<blockquote>so it is</blockquote><table><tr><td>1<td>2</table><div class=ad>Buy</div>"
    assert extraction.main_text(f"<main><p>{long}</p>{more}</main>") == f"{long} so it is 1 2"
    deep = "<div>" * 5000 + f"<p>{long}"
    assert extraction.main_text(deep) == long
    apart = f"<body><div>Home</div><div><p>{long}</p></div><div><p>{short}</p></div><div><p>{long}</p></div><div>bye</div></body>"
    assert extraction.main_text(apart) == f"{long} {short} {long}"


@pytest.mark.parametrize(("html", "text"), [
    ("<html><head><title>x</title><body><article><p>One text here.</p></article>", "One text here."),
    ("<html><head><title>x</title><meta charset=utf-8><article><p>One text here.</p></article>", "One text here."),
    ("<head><script>var a;</script><div><p>One text here.</p></div>", "One text here."),
    ("<body><article><p>First part.</p><select><option>a<option>b<p>Second part.</p></article>", "First part. Second part."),
    ("<body><article><p>First part.</p><form><select><option>a</form><p>Second part.</p></article>", "First part. Second part."),
    ("<body><article><p>First part.</p><section id=search><p>Second part.</p></section></article>", "First part. Second part."),
    ("<body><div id=search><p>Look here.</p></div><article><p>First part.</p></article>", "First part."),
    ("<body><article><ul><li>One<li>Two</ul><p>A<p>B<table><tr><td>C<td>D</table></article>", "One Two A B C D"),
])
def test_extraction_with_ends_left_out(html, text):
    assert extraction.main_text(html) == text


def test_extraction_keeps_pages_apart(spark):
    pages = spark.createDataFrame([(*p, "d", 1) for p in pages_of()], PAGES)
    found = rows(extraction.extract(pages), "page_id", "n_chars")
    same(found, [(i, len(" ".join((h or "").split()))) for i, _, h in pages_of()])


def test_licenses(documents, texts):
    found = licenses.report(licenses.scan(documents))
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(rows(found, *names), [(d, *brute.phrases(t)) for d, t in texts])
    by_id = {r["doc_id"]: r for r in found.collect()}
    at = {t: d for d, t in texts}
    assert by_id[at["Released under teh MIT License."]]["labels"] == "mit"
    assert 0.9 < by_id[at["Released under teh MIT License."]]["score"] < 1
    assert by_id[at["This work is licensed under the GNU General Public License, version 3."]]["labels"] == "gpl,gpl-3"


def test_licenses_of_a_text_full_of_phrases():
    prepared = licenses.prepare(licenses.NOTICES)
    notice = prepared[0].text
    text = f"{'cc by x ' * 200_000}{(notice + ' y ') * 2_000}"
    start = time.monotonic()
    found = licenses.scan_text(text.encode(), prepared, [n.pattern() for n in prepared])
    assert time.monotonic() - start < 60
    assert (found["n_base"], found["first_word"]) == (200_000, 0)
    assert found["last_word"] == 3 * 199_999
    assert len(found["spans"]) == 2_000
    assert all(a["end"] <= b["start"] for a, b in zip(found["spans"], found["spans"][1:], strict=False))


def test_fuzzy_search_finds_every_notice_within_its_edits():
    rng = random.Random(4)
    notices = licenses.prepare()
    patterns = [n.pattern() for n in notices]
    for notice in notices:
        for _ in range(30):
            text = list(notice.text)
            for _ in range(rng.randint(0, notice.errors)):
                at = rng.randrange(len(text))
                text[at : at + rng.choice((0, 1))] = rng.choice(("", "q", "z"))
            raw = f"{' '.join(words(rng, 20))} {''.join(text)} {' '.join(words(rng, 20))}".encode()
            found = licenses.fuzzy_spans(licenses.normal(raw)[0], notice, patterns[notices.index(notice)], {})
            assert len(found) == 1 and found[0][2] <= notice.errors


def test_empty_tables(spark, nothing):
    no_items, no_labels = spark.createDataFrame([], ITEMS), spark.createDataFrame([], LABELS)
    for df in (
        jaccard.jaccard_components(nothing), jaccard.one_of_each(nothing), mixing.report(nothing), scoring.score(nothing),
        decontamination.report(decontamination.contamination(nothing, no_items)), decontamination.decontaminate(nothing, no_items),
        rules.judge(nothing, no_labels), classifier.classify(nothing, no_labels), classifier.accepted(nothing, no_labels),
        substrings.report(nothing), substrings.without_repeats(nothing), licenses.scan(nothing),
    ):
        assert df.count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    data = [(i, t) for i, t in dict(corpus(11)).items() if i is not None]
    docs = as_documents(spark, data)
    items = [("7", " ".join(brute.alnum(max((t for _, t in data if t), key=len))[200:230]))]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, data).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(*i, 1, "w", 2) for i in items], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        now = spark.read.parquet(f"{tmp_path}/out/{name}")
        after = [(r["doc_id"], r["text"]) for r in now.collect()] if step < 4 else None
        if step == 0:
            assert set(after) <= set(before)
        elif step == 1:
            same(sorted(after, key=repr), [b for b, c in zip(before, brute.components(before, 5, 80), strict=True) if b[0] == c[2]])
        elif step == 2:
            want = {d: r for d, r in ((e[0], e) for e in brute.removals(before)) if r[1] == 0 or r[2] < r[1]}
            assert {d: brute.sha(" ".join(brute.spaced(t))) for d, t in after} == {d: r[3] for d, r in want.items()}
        elif step == 3:
            same(sorted(after, key=repr), [b for b, c in zip(before, brute.contamination(before, items), strict=True) if not c[5]])
        else:
            assert sorted(r["doc_id"] for r in now.collect()) == sorted(d for d, _ in before)
