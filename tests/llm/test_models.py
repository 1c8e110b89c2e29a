"""Languages, markup, scanned pages and near-duplicates on small tables."""

import random

import pytest

from quill.llm import languages, markup, near_duplicates, scanned


# p2


def test_automaton_counts_longest_matches():
    a = languages.Automaton(["gato", "casa"])
    assert a.phrases("gato") == 1 and a.phrases("casa") == 1 and a.phrases("casato") == 2 and a.phrases("xyz") == 4

    def brute(word, words):
        known, n, s = [f" {w} " for w in words], 0, f" {word} "
        while s:
            k = max((k for k in range(1, len(s) + 1) if any(s[:k] in w for w in known)), default=0)
            if k == 0:
                s, n = s[1:], n + 1
                continue
            s, n = s[k:], n + 1
        return n

    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(30)]
    a = languages.Automaton(words)
    for _ in range(300):
        w = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        assert a.phrases(w) == brute(w, words), w


def test_languages_of_held_out_documents(spark, folder):
    small = folder.replace("sf0.001", "sf0.01")
    df = spark.read.parquet(f"{small}/documents.parquet").selectExpr("'documents' AS tab", "cast(doc_id AS string) AS item", "text", "idioma AS label")
    names = spark.read.parquet(f"{small}/language_names.parquet")
    words = languages.trained(df.filter("cast(item AS bigint) % 2 = 0"), names)
    known = languages.label_table(names)
    rows = languages.main_language(df.filter("cast(item AS bigint) % 2 = 1 AND length(text) > 300"), words).collect()
    label = {r.item: known.get((r.label or "").strip().lower()) for r in df.collect()}
    said = [(r.lang, label[r.item]) for r in rows if label[r.item]]
    assert sum(a == b for a, b in said) / len(said) > 0.8  # a part of the labels is wrong
    assert all(0 <= r.confidence <= 1 for r in rows)


def test_automata_decide_whatever_the_letters():
    """Of languages with labelled text the automata alone decide, letters only of those without."""
    own = languages.Model((("ru", ("сирены", "река")), ("es", ("ракета", "река", "casa"))))
    lang = {w: languages.LANGUAGES[min(range(len(languages.LANGUAGES)), key=own.vectors([w])[0][:-1].__getitem__)] for w in ("ракета", "сирены", "casa", "ありがとう", "गाँव")}
    assert lang == {"ракета": "es", "сирены": "ru", "casa": "es", "ありがとう": "ja", "गाँव": "hi"}


def test_training_texts_are_bounded_in_bytes(spark, monkeypatch):
    rows = [(str(i), f"palabra{chr(97 + i % 26)}{chr(97 + i // 26)} " * 40, "es", "extra") for i in range(60)]
    df = spark.createDataFrame(rows, "item string, text string, label string, lang string")
    names = spark.createDataFrame([("es", "es")], "label string, lang string")
    seen = []
    monkeypatch.setattr(languages, "training_words", lambda texts: seen.append(sum(map(len, texts["es"]))) or {})
    languages.trained(df, names)
    monkeypatch.setattr(languages, "SAMPLE_BYTES", 5000)
    languages.trained(df, names)
    assert 4000 < seen[1] <= 5000 < seen[0]


def test_segments_of_edge_cases(spark):
    rows = [("documents", "1", None, None, 1), ("documents", "2", "", "es", 1), ("documents", "3", "12345 !!", "es", 1), ("documents", None, "谁审查了农村普查？", None, 1)]
    df = spark.createDataFrame(rows, "tab string, item string, text string, label string, lang int")
    out = languages.segments(df, ()).collect()
    assert [(r.item, r.lang) for r in out] == [(None, "zh")]
    main = {r.item: (r.lang, r.confidence) for r in languages.main_language(df, ()).collect()}
    assert main["1"] == main["2"] == main["3"] == (None, 0.0)


# p5


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("plain text with 3 < 4 & 5 (* p < 0,05) US$ 3", []),
        ("<h2>Cat&#225;logo <b>r</b></h2>\n<p>x \\(a = b\\)</p><ul><li>one<li>two <a href='u'>l</a></ul><pre><code>a &lt; b</code></pre>",
         [("residue", "html"), ("heading", "Catálogo r"), ("formula", "a = b"), ("list_item", "one"), ("list_item", "two l"), ("code_block", "a < b")]),
        ("# Head **x** #\n\ntext $a^2$\n\n- one\n    + [two](http://u)\n\n```py\n# no head\n```\nUnder\n-----\n",
         [("residue", "markdown"), ("heading", "Head x"), ("formula", "a^2"), ("list_item", "one"), ("list_item", "two"), ("code_block", "# no head"), ("heading", "Under")]),
        ("{{Box\n| a = b\n}}\n== Head ''x'' ==\n* [[A|one]]\n## [http://u two]\n<math>x</math>\n<syntaxhighlight lang=\"c\">\ny\n</syntaxhighlight>\n[[Category:z]]",
         [("residue", "wiki"), ("heading", "Head x"), ("list_item", "one"), ("list_item", "two"), ("formula", "x"), ("code_block", "y")]),
        ("\\section*{Cat\\'{a}logo {\\it x}}\nt~\\cite{a}\n\\begin{itemize}\n\\item \\textbf{one}\n\\item t\\'{\\i}o\n\\end{itemize}\n\\begin{equation}\nE = 1\n\\end{equation}\n\\begin{verbatim}\n\\item no\n\\end{verbatim}",
         [("residue", "latex"), ("heading", "Catálogo x"), ("list_item", "one"), ("list_item", "tío"), ("formula", "E = 1"), ("code_block", "\\item no")]),
    ],
)
def test_markup_elements(text, want):
    assert sorted(markup.elements_of(text)) == sorted(want)


def test_markup_tables(spark):
    rows = [(1, "<p>Hi</p>", 1), (2, None, 2), (3, "", 3), (4, "plain", 4), (1, "<p>Hi</p>", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, element int")
    assert sorted((r.doc_id, r.element, r.content) for r in markup.elements(df).collect()) == [(1, "residue", "html")] * 2
    clean = {r.doc_id: (r.markup, r.text) for r in markup.clean(df).collect()}
    assert clean == {1: ("html", "Hi"), 2: (None, None), 3: (None, ""), 4: (None, "plain")}


def test_short_blocks_inherit_their_neighbours_label():
    good = "The laboratory of the river confirmed the model in the region and the council of the town published the plan for the year to come with help from several universities."
    menu = "[Home](u) [News](u) [Contact](u) [About](u) [Login](u) [Help](u)"
    text = f"{good}\n\nA short line between them\n\n{good}\n\n{menu}\n\nShare\n\n{menu}"
    out = markup.render(markup.read_markdown(text))
    assert "A short line" in out and "Share" not in out and "Contact" not in out


def test_elements_pass_through_the_two_passes(monkeypatch):
    good = "The laboratory of the river confirmed the model in the region and the council of the town published the plan for the year to come with help from several universities."
    menu = "## Elsewhere\n\n- [Home page](u)\n- [News of the day](u)\n- [Contact](u)"
    listed = "## Results\n\n- the [plan](u) of the river\n- a second item\n- [third](u)"
    text = f"{good}\n\n{listed}\n\n{good}\n\n{good}\n\n[Share](u) [Print](u)\n\n{menu}\n"
    found = markup.elements_of(text)
    assert sorted(found) == sorted([("residue", "markdown"), ("heading", "Results"), ("list_item", "the plan of the river"), ("list_item", "a second item"), ("list_item", "third")])
    assert "Elsewhere" not in markup.render(markup.read_markdown(text))
    monkeypatch.setattr(markup, "LIST_LINKS", 2.0)
    monkeypatch.setattr(markup, "HIGH_LINKS", 2.0)  # without link density the menu counts
    assert ("list_item", "Contact") in markup.elements_of(text)


def test_prose_of_every_script_is_kept(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet")
    kept = markup.prose(docs).groupBy("script").agg(F.avg(F.col("kept").cast("int")).alias("share"), F.count("*").alias("n")).collect()
    assert {r.script for r in kept} >= {"latin", "cyrillic", "ideographic", "devanagari"}
    assert all(r.share >= 0.99 for r in kept)


LONG = {
    "hi": "तब से राकारी के सीमावर्ती न्यायालय ने लंबे विवाद के बाद ग्रामीण प्रणाली की आलोचना की। निवासियों के अनुसार रीलीकाली के तकनीकी केंद्र ने वर्षा ऋतु में कक्षीय संधि की घोषणा की और नई योजना को गाँव के लोगों के लिए प्रकाशित किया।",
    "th": "กระทรวงอิสระในเฟโกตูโกได้ตรวจสอบแผนที่แม่น้ำของเฟฮาเฟรวม 2540 กรณี อย่างไรก็ตามคณะกรรมการชายแดนของมาคาสาได้เลื่อนระเบียงชนบทหลังข้อพิพาทยาวนาน ดร.เนรีโกกล่าวว่าต้องเลื่อนดาวเทียมวงโคจรภายใต้การกำกับของพลเรือน",
    "ru": "«Нужен речной договор. Старый план устарел», — заявил Ведобака без согласия общин. Приграничный комитет района Паками описал сельский проект, т. е. 5354 случая в городе Ратумиве. Региональный институт оценил миграционный коридор.",
    "ar": "وفقا للسكان، وسّع الفريق الإقليمي في راراكا البروتوكول الصحي بعد نزاع طويل. قال د. ساتودوكا: «لا يكفي البروتوكول التنبؤي. نحتاج إلى فريق آخر». وفقا للسكان، قيّم المعهد الأولي في ريزافيمي البروتوكول الإقليمي رغم نقص البيانات.",
    "ja": "ソソズは「農村衛星では足りない。新しい常設委員会が必要だ。」と述べた。 ソサハモは「河川計画では足りない。新しい自治協議会が必要だ。」と述べた。 ルモトソは「保健アルゴリズムでは足りない。新しい技術裁判所が必要だ。」と述べた。 誰が計画を公表したのか？ 村の人々は新しい計画を待っている。",
    "tr": "Bağımsız kurul, nehir haritasını uzun tartışmalardan sonra yeniden değerlendirdi. Köylerde yaşayanlara göre bölgesel merkez, yağmur mevsiminde yeni yörünge anlaşmasını yayımladı ve eksik verilere rağmen planı onayladı.",
}


@pytest.mark.parametrize("lang", LONG)
def test_long_paragraphs_of_any_language_stay(lang):
    menu = "[Home](u) [News](u) [Contact](u) [About](u) [Login](u) [Help](u)"
    assert len(LONG[lang]) >= markup.GOOD_LENGTH
    assert markup.render(markup.read_markdown(f"{menu}\n\n{LONG[lang]}\n\n{menu}")) == LONG[lang]


def test_long_lists_of_names_go_where_the_stop_words_fit():
    names = {"ru": "Главная страница Новости Карта Контакты Вход Помощь Архив Реклама " * 3, "hi": "मुखपृष्ठ समाचार मानचित्र संपर्क प्रवेश सहायता अभिलेख विज्ञापन " * 3, "ar": "الرئيسية الأخبار الخريطة اتصال دخول مساعدة أرشيف إعلانات " * 3}
    for lang, line in names.items():
        body = "\n\n".join([LONG[lang]] * 3)
        assert markup.render(markup.read_markdown(f"{body}\n\n{line.strip()}")) == body


# p6


PAGE = """RUNNING TITLE OF THE REPORT
The laboratory rebuilt the tracking system with 4952 cases in the
northern valley before the new tender. The programme expanded the cor-
ridor during the last quarter. The ministry questi0ned the model of
the river despite missing records and the council of the
- 12 -
RUNNING TITLE OF THE REPORT
region published the framevvork under civilian oversight. The report
measured the plan and the village according to the official account
of the mediators once they had left the territory of the border
group for budget reasons in the middle of the rainy season today.
- 13 -"""
LEXICON = "The ministry questioned the framework and the model, which the laboratory of the region published. " * 2


def test_scanned_pages_with_a_wide_header_or_capital_nouns():
    header = " ".join("Autonomous ministry and inventory in the northern river valley")
    body = "On the other hand, the command suspended the rural\ncensus of Tamves during the\nlast quarter of the year, and the\nministry listed the radars and the\nsensors of the border centre"
    assert scanned.is_scanned(f"{body}\n{header}\n100\n{body}", "image")
    german = "Der Beirat prüfte den Algorithmus der Gemeinden in Valfotín und den\nKorridor der Gemeinden in Narvosco unter ziviler Aufsicht. Der\nVerein verschob den Entwurf der Akademie von Hultando und den Plan der\nStreitkräfte in Falsesco nach langem Streit über die Bewertung der\nUmlaufbahn durch den Verband der Akademie"
    assert scanned.is_scanned(f"{german}\n- 66 -\n\x0c\n{german}", "pdf")
    assert not scanned.is_scanned(german, "pdf") and not scanned.is_scanned(f"{german}\n- 66 -", "txt")
    assert not scanned.is_scanned("A notice of the site\nAnother line here\n" + "The council measured the plan of the river. " * 5 + "\nshare this story", "txt")


def test_scanned_findings(spark):
    clean = [(i, LEXICON, "txt") for i in range(10, 14)]
    df = spark.createDataFrame([(1, PAGE, "pdf"), (2, None, "pdf"), (3, "", None), (4, "Short.", "pdf"), *clean], "doc_id bigint, text string, formato string")
    out = {(r.doc_id, r.line_no): r.kind for r in scanned.findings(df).collect()}
    assert out == {(1, 0): "header", (1, 6): "header", (1, 5): "page_no", (1, 11): "page_no", (1, 2): "hyphen", (1, 3): "misread", (1, 7): "misread"}
    fixed = {r.doc_id: (r.scanned, r.text) for r in scanned.repair(df).collect()}
    assert fixed[2] == (False, None) and fixed[4] == (False, "Short.")
    text = fixed[1][1]
    assert fixed[1][0] and "corridor" in text and "questioned" in text and "framework" in text and "RUNNING" not in text and "12" not in text and "\n" not in text
    assert scanned.findings(df.filter("doc_id < 0")).count() == 0


def test_editor_learns_confusions():
    words = ["laboratory", "community", "independent", "framework", "published", "territorial", "mediators", "catalogue", "statistical"] * 30
    editor = scanned.Editor().train([(w, 5) for w in words])
    for word, noisy in [("community", "comrnunity"), ("independent", "inclependent"), ("framework", "framevvork"), ("published", "piiblished"), ("territorial", "territ0rial"), ("community", "cornrnunity")]:
        scores = {fix: s + editor.of_fix(5) for fix, _, s in editor.candidates(noisy)}
        assert scores[word] > 0, noisy
    assert editor.of_fix(0) < 0 < editor.of_fix(5)
    assert editor.by_signs("territ0rial")[1] > 0 and editor.by_signs("territorial")[1] == 0


def test_editor_decides_line_ends():
    words = [("laboratory", 5), ("community", 9), ("river", 3), ("framework", 12), ("published", 2), ("corridor", 4), ("mediators", 7)] * 40
    editor = scanned.Editor().train(words)
    said = lambda *x: editor.line_end(*x)
    assert said("cor", "", "-", "ridor", 4, 0, 0, 0) == scanned.JOIN
    assert said("porta", "", "-", "voz", 0, 4, 5, 5) == scanned.JOIN_HYPHEN
    assert said("river", " ", "-", "published", 0, 0, 3, 2) == scanned.KEEP == said("river", "", "–", "published", 0, 0, 3, 2)
    assert scanned.Editor().line_end("cor", "", "-", "ridor", 4, 0, 0, 0) == scanned.KEEP


def test_every_finding_of_letters_and_line_ends_is_the_editors(spark, monkeypatch):
    """Without training the editor keeps everything, and nothing but furniture is found."""
    clean = [(i, LEXICON, "txt") for i in range(10, 14)]
    df = spark.createDataFrame([(1, PAGE, "pdf"), *clean], "doc_id bigint, text string, formato string")
    monkeypatch.setattr(scanned.Editor, "train", lambda self, words, **_: self)
    assert {r.kind for r in scanned.findings(df).collect()} == {"header", "page_no"}
    fixed = {r.doc_id: r.text for r in scanned.repair(df).collect()}
    assert "questi0ned" in fixed[1] and "cor- ridor" in fixed[1]


def test_hyphens_that_belong_to_the_word_stay(spark):
    page = PAGE.replace("expanded the cor-\nridor during", "asked the porta-\nvoz during")
    clean = [(i, f"{LEXICON} The porta-voz spoke.", "txt") for i in range(10, 14)]
    df = spark.createDataFrame([(1, page, "pdf"), *clean], "doc_id bigint, text string, formato string")
    assert "the porta-voz during" in {r.doc_id: r.text for r in scanned.repair(df).collect()}[1]
    assert (1, 2, "hyphen") in [tuple(r) for r in scanned.findings(df).collect()]


def test_a_sign_may_be_any_letter_of_a_script_however_large(spark):
    """More than 200 letters of Latin and of Hangul stand in the lexicon."""
    latin = [c for c in map(chr, range(0xDF, 0x2B0)) if c.islower()]
    hangul = [chr(cp) for cp in range(0xAC00, 0xAC00 + 28 * 250, 28)]
    letters = " ".join("".join(part[i : i + 3]) for part in (latin, hangul) for i in range(0, len(part), 3))
    page = PAGE.replace("questi0ned", "questi#ned").replace("missing records", "정#원 records").replace("laboratory rebuilt", "l#borat#ry rebuilt").replace("mediators", "m#d#at#rs")
    clean = [(i, f"{LEXICON} 정보원 mediators {letters}", "txt") for i in range(10, 14)]
    df = spark.createDataFrame([(1, page, "pdf"), *clean], "doc_id bigint, text string, formato string")
    assert len(latin) > 200 < len(hangul)
    text = {r.doc_id: r.text for r in scanned.repair(df).collect()}[1]
    assert "The laboratory rebuilt" in text and "questioned" in text and "정보원 records" in text
    assert "m#d#at#rs" in text  # three edits
    assert {(1, 1, "misread"), (1, 3, "misread"), (1, 4, "misread")} <= {tuple(r) for r in scanned.findings(df).collect()}


def test_blanks_meet_every_word_that_letters_make_of_them(spark):
    rng = random.Random(3)
    lexicon = sorted({"".join(rng.choices("abàж名字𠀀-²", k=rng.randint(2, 5))) for _ in range(4000)})
    words = sorted({"".join(rng.choices("abж名𠀀#5-\ufdd0", k=rng.randint(2, 5))) for _ in range(400)})
    proposed = [(w, fix, ease, float(s)) for w in words for fix, ease, s in scanned.Editor().candidates(w) if scanned.BLANK in fix]
    right = set()
    for word, blanked, *_ in proposed:
        own = next((scanned.script(c) for c in word if c.isalpha()), "")
        for fix in lexicon:
            if len(fix) == len(blanked) and all(c == b or (b == scanned.BLANK and c.isalpha() and scanned.script(c) == own) for c, b in zip(fix, blanked)):
                right.add((word, fix))
    known = spark.createDataFrame([(w, 2) for w in lexicon], "fix string, n bigint")
    asked = spark.createDataFrame(proposed, "word string, fix string, ease int, score double")
    assert {len(x[1]) - len(x[1].replace(scanned.BLANK, "")) for x in proposed} == {1, 2}
    assert len(right) > 100 and {(r.word, r.fix) for r in scanned._met(asked, known).collect()} == right
    none = scanned._met(asked.filter("ease > 9"), known)
    assert none.count() == 0 and [c for c, _ in none.dtypes] == ["word", "fix", "ease", "score", "n"]


# p7


def grams(t):
    t = " ".join(t.lower().split())
    return {t[i : i + 5] for i in range(len(t) - 4)}


def test_similar_records_by_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=45)) for _ in range(60)]
    rows = [("chunk_meta", f"c{i}", t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        for n in range(3):
            v = list(w)
            for _ in range(rng.choice([1, 2, 4, 8])):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            if n == 2:
                v = v[20:] + v[:20]
            rows.append((rng.choice(["chunk_meta", "fragments"]), f"e{i}-{n}", " ".join(v).upper() if n == 0 else " ".join(v)))
    rows += [("chunk_meta", "copy1", base[0]), ("chunk_meta", "copy2", base[0] + "  "), ("chunk_meta", "c1", base[1]), ("fragments", "f", base[0])]
    rows += [("chunk_meta", "null", None), ("chunk_meta", "short", "abc"), ("chunk_meta", "short2", "abc"), (None, "x", "no table at all"), ("chunk_meta", None, base[2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tab string, id string, text string, c string")
    own = {(t, i): grams(x) for t, i, x in rows if x and i and t and len(x) >= 5}
    want = set()
    keys = sorted(own)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if a[0] == b[0] and len(own[a] & own[b]) >= 0.7 * len(own[a] | own[b]):
                want.add((a[0], a[1], b[1]))
    got = [tuple(r) for r in near_duplicates.similar_records(df).collect() if r[0]]
    assert len(got) == len(set(got))
    assert set(got) <= want and len(set(got)) >= 0.99 * len(want)
    few = {tuple(r) for r in near_duplicates.similar_records(df, within=1).collect() if r[0]}
    assert few <= set(got) and {("chunk_meta", "c0", "copy1"), ("chunk_meta", "c0", "copy2")} <= few
    groups = {(r.tab, r.id): r.group_id for r in near_duplicates.groups(df).collect()}
    assert groups["chunk_meta", "copy1"] == groups["chunk_meta", "c0"] and groups["chunk_meta", "c0"] != groups["chunk_meta", "c5"]
    assert near_duplicates.similar_records(df.filter("id = 'none'")).count() == 0


def test_a_chain_of_edited_texts_is_one_group(spark):
    rng = random.Random(9)
    line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20 * 300 + 200))
    rows = [("chunk_meta", f"c{i:03}", line[20 * i : 20 * i + 200]) for i in range(300)]  # alike only to the next
    out = near_duplicates.groups(spark.createDataFrame(rows, "tab string, id string, text string")).collect()
    assert len(out) == 300 and {r.group_id for r in out} == {"c000"}
    assert sorted(r.links for r in out) == [1, 1] + [2] * 298


def test_components_of_paths_and_random_graphs(spark):
    rng = random.Random(2)
    ids = rng.sample(range(-(10**9), 10**9), 1500)
    edges = list(zip(ids[:1000], ids[1:1000])) + [tuple(rng.sample(ids[1000:], 2)) for _ in range(300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = near_duplicates.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len(root) and {r.c: r.l for r in got} == {x: find(x) for x in root}


def test_trie_join_is_exact():
    import numpy as np

    rng = np.random.default_rng(4)
    n = 3000
    rows = np.zeros(n, near_duplicates.RECORD)
    rows["lo"], rows["key"] = np.arange(n), rng.integers(0, 3, n)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    pick = rng.integers(0, 40, n)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), False)) for _ in range(2 * n)]
    rows["a"] = base[pick, 0] ^ np.array(flips[:n], np.uint64)
    rows["b"] = base[pick, 1] ^ np.array(flips[n:], np.uint64)
    rows = rows[np.lexsort((rows["b"], rows["a"], rows["key"]))]
    lo, hi = near_duplicates.buckets(rows)
    got = {tuple(sorted(p)) for x, y in near_duplicates.trie_join(rows, (lo, hi, lo, hi), 12) for p in zip(x.tolist(), y.tolist())}
    d = np.bitwise_count(rows["a"][:, None] ^ rows["a"][None]).astype(int) + np.bitwise_count(rows["b"][:, None] ^ rows["b"][None])
    i, j = np.nonzero((d <= 12) & (rows["key"][:, None] == rows["key"][None]))
    assert got == {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist()) if p[0] != p[1]}


def edited(rng, n, words=8):
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        w = rng.choices(vocabulary, k=words)
        rows += [("chunk_meta", f"a{i}", " ".join(w)), ("chunk_meta", f"b{i}", " ".join([*w[:-1], rng.choice(vocabulary)]))]
    return rows


def brute(rows):
    own = {i: grams(t) for _, i, t in rows}
    return {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) >= 0.7 * len(own[a] | own[b])}


def test_short_texts_are_found_exactly(spark):
    rows = edited(random.Random(3), 250, 5) + edited(random.Random(4), 250, 3)
    rows = [(t, f"{n}{i}", x) for n, (t, i, x) in enumerate(rows)]
    want = brute(rows)
    got = {(r.id_a, r.id_b) for r in near_duplicates.similar_records(spark.createDataFrame(rows, "tab string, id string, text string")).collect()}
    assert got <= want and len(got) >= 0.998 * len(want) and len(want) > 60


def test_frequent_keys_are_cut_into_groups_and_lose_nothing(spark, monkeypatch):
    """Every record of a table that shares its keys, with parts so small that all keys are frequent."""
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400))
    rows = [("chunk_meta", f"r{i:03}", base[: 380 - i % 7] + "".join(rng.choices("xyz", k=12))) for i in range(150)]
    df = spark.createDataFrame(rows, "tab string, id string, text string")
    monkeypatch.setattr(near_duplicates, "HOT", 16)
    whole = {(r.id_a, r.id_b) for r in near_duplicates.similar_records(df).collect()}
    monkeypatch.setattr(near_duplicates, "PART_BYTES", 40 * near_duplicates.RECORD.itemsize)
    monkeypatch.setattr(near_duplicates, "SHARE", 1)
    assert max(near_duplicates._frequent(df, 1).values()) >= 3
    cut_up = {(r.id_a, r.id_b) for r in near_duplicates.similar_records(df).collect()}
    assert whole == cut_up == brute(rows)


def test_comparison_is_exact_for_any_alphabet():
    rng = random.Random(6)
    texts = {bytes([i]): "".join(chr(rng.randrange(0x4E00, 0x4E00 + 20 + 3000 * (i % 3))) for _ in range(5 + i * 40)) for i in range(40)}
    texts |= {bytes([100 + i]): t[: len(t) - i] + "x" * (i % 4) for i, t in enumerate(texts.values()) if len(t) - i > 5}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    want = [len(x & y) >= 0.7 * len(x | y) for x, y in (tuple({texts[c][i : i + 5] for i in range(len(texts[c]) - 4)} for c in p) for p in pairs)]
    assert near_duplicates.alike(pairs, texts, 0.7) == want and sum(want) > 20


def test_parts_grow_with_the_records(spark):
    few, many = near_duplicates.parts_of(spark, 10**7), near_duplicates.parts_of(spark, 10**8)
    assert many >= 9 * few > 36 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_every_query_runs(spark, folder):
    from quill.llm import queries

    for name, f in queries.queries().items():
        rows = f(spark, folder)
        assert rows.count() > 0 or name == "p10_found", name


def test_every_query_on_empty_tables(spark, empty_folder):
    from quill.llm import queries

    for name, f in queries.queries().items():
        assert f(spark, empty_folder).count() == (name == "p9_fullness"), name  # one row about nothing
