"""Golden cases of the engine's operators on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import text as X
from ledgerlight.functions.similarity import indel_distance, ratio, with_token_set_ratio
from ledgerlight.operators import analytics as A
from ledgerlight.operators import feedback as B
from ledgerlight.operators import gates as G
from ledgerlight.operators import log as L
from ledgerlight.operators import migrate as M
from ledgerlight.operators import projection as P
from ledgerlight.operators import ranking as R
from ledgerlight.sources import files
from ledgerlight.streaming import fold


def log(spark, text):
    rows = [(i, *line.split("|")) for i, line in enumerate(text.strip().split("\n"), 1)]
    return spark.createDataFrame(rows, "line_no bigint, date string, event string, target string, session string")


def facts(spark, rows):
    base = {"name": "", "description": "", "type": "note", "created": "2026-04-01", "status": "active", "keywords": [], "domains": [], "evidence": [], "skill": "", "precision_class": "", "recurrence": 0, "success_count": 0, "content_sha": "", "body": "", "project": "p", "doc_id": 0}
    schema = "slug string, name string, description string, type string, created string, status string, keywords array<string>, domains array<string>, evidence array<string>, skill string, precision_class string, recurrence bigint, success_count bigint, content_sha string, body string, project string, doc_id bigint"
    return spark.createDataFrame([tuple({**base, **r}[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)


def one(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return df.first().asDict()


@pytest.mark.parametrize(
    "ref, eff, created, project, overlap, expected",
    [(0, 0.5, "2026-05-01", "x", 2, 8.034483), (100, 0.5, "2026-05-01", "x", 0, 4.038804), (0, 0.0, "", "x", 0, 0.0), (300, 0.05, "2026-05-29", "x", 0, 2.347857), (0, 0.5, "", "p", 1, 5.0)],
)
def test_score(spark, ref, eff, created, project, overlap, expected):
    row = spark.createDataFrame([(ref, eff, "", created, project)], "ref_count bigint, effectiveness double, last_injected string, created string, project string")
    got = row.select((3 * F.lit(overlap) + R.static_score(F.lit("2026-05-29"), F.lit("p"))).alias("s")).first()["s"]
    assert round(got, 6) == expected


def test_tokens(spark):
    cases = {
        "of it zoo quux": ["zoo", "quux"],
        "тихий дом у реки": ["тихий", "дом", "реки"],
        "left_over Right2 2024": ["left_over", "right2", "2024"],
        "alpha;beta=gamma/é": ["alpha", "beta", "gamma"],
        "because their garden would bloom": ["garden", "bloom"],
        "red RED red": ["red", "red", "red"],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", X.tokenize(F.col("t")).alias("x")).collect()} == cases
    assert spark.range(1).select(X.tokenize(F.lit(None).cast("string")).alias("x")).first()["x"] == []


def test_projection_counts_and_merge(spark):
    w = log(spark, "\n".join(["2026-04-01|inject|m|s1", "2026-04-02|inject|m|s2", "2026-04-03|inject|m|s3", "2026-04-04|outcome-positive|m|s1", "2026-04-05|outcome-negative|m|s2", "2026-04-06|inject-agg|a|20", "2026-04-06|inject|a|s1", "2026-04-06|inject-agg|a|x"]))
    f = facts(spark, [{"slug": "m.md", "created": ""}, {"slug": "a.md"}, {"slug": "none.md"}])
    p = P.reproject(f, w)
    assert one(p, slug="m.md") | {"ref_count": 3, "effectiveness": 0.5, "created": "2026-04-01", "last_injected": "2026-04-03"} == one(p, slug="m.md")
    assert one(p, slug="a.md")["ref_count"] == 22
    assert one(p, slug="none.md")["effectiveness"] == 0.5


def test_useful_wins_and_projects_apart(spark):
    sep = "\x1f"
    lines = [f"2026-04-0{i}|trigger-useful|one{sep}x|s{i}" for i in range(1, 4)] + [f"2026-04-0{i}|trigger-silent|two{sep}x|s{i}" for i in range(1, 4)] + [f"2026-04-05|trigger-silent|one{sep}x|s1", "2026-04-06|trigger-useful|y|s1"]
    f = facts(spark, [{"slug": "x.md", "project": "one"}, {"slug": "x.md", "project": "two"}, {"slug": "y.md", "project": "one"}])
    p = P.reproject(f, log(spark, "\n".join(lines)))
    assert round(one(p, slug="x.md", project="one")["effectiveness"], 6) == 0.8
    assert round(one(p, slug="x.md", project="two")["effectiveness"], 6) == 0.2
    assert round(one(p, slug="y.md")["effectiveness"], 6) == round(2 / 3, 6)


def test_holdout(spark):
    text = "2026-01-01|ablate-start|p\x1fx:3|cli\n2026-01-02|holdout-skip|p\x1fx|s1\n2026-01-02|holdout-skip|p\x1fx|s2\n2026-01-02|holdout-skip|p\x1fx|s2"
    assert L.holdout_remaining(L.keyed(log(spark, text))).first()["remaining"] == 1
    assert L.holdout_remaining(L.keyed(log(spark, text + "\n2026-01-03|ablate-stop|p\x1fx:manual|cli"))).first()["remaining"] == 0


def test_reconcile_retired_and_revived(spark):
    w = log(spark, "2026-01-01|retire|p\x1fa>b:old|cli\n2026-01-01|retire|p\x1fc|cli\n2026-01-02|revive|p\x1fc|cli")
    stored = spark.createDataFrame([("p", "c.md", "active"), ("q", "d.md", "active")], "project string, slug string, status string")
    got = {(r["project"], r["slug"]): r["status"] for r in P.reconcile(stored, facts(spark, [{"slug": "l.md"}]), w, []).collect()}
    assert got == {("p", "l.md"): "active", ("p", "a.md"): "retired", ("p", "c.md"): "deleted", ("q", "d.md"): "active"}


def test_commutative_fold_ignores_order_and_lifecycle_does_not(spark):
    lines = ["2026-04-01|inject|m|s1", "2026-04-02|trigger-useful|m|s1", "2026-04-03|trigger-silent|m|s1", "2026-04-04|outcome-negative|m|s2"]
    shuffled = random.Random(3).sample(lines, len(lines))
    f = facts(spark, [{"slug": "m.md"}])
    assert P.reproject(f, log(spark, "\n".join(lines))).collect() == P.reproject(f, log(spark, "\n".join(shuffled))).collect()
    a, b = "2026-01-01|retire|m|cli", "2026-01-01|revive|m|cli"
    retired = [L.lifecycle(L.keyed(log(spark, f"{x}\n{y}"))).first()["retired"] for x, y in ((a, b), (b, a))]
    assert retired == [False, True]


def test_validation(spark):
    lines = ["# header", "2026-01-01|inject|a|s", "2026-01-01|inject|a", "2026-1-1|inject|a|s", "2026-01-01|Inject|a|s", "2026-01-01|inject|a|", ""]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no bigint, value string")
    assert {r["line_no"]: r["reason"] for r in L.validate(df).collect()} == {2: None, 3: "columns", 4: "date", 5: "event", 6: "session"}


def plain_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def plain_set_ratio(a, b):
    """The best of three ratios over shared and own tokens."""
    sets = [set("".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).split()) for t in (a, b)]
    if not all(sets):
        return 0.0
    shared, own, other = (" ".join(sorted(x)) for x in (sets[0] & sets[1], sets[0] - sets[1], sets[1] - sets[0]))
    if shared and not (own and other):
        return 100.0
    s = len(shared) + bool(shared)
    found = [100 * 2 * (s + plain_lcs(own, other)) / (2 * s + len(own) + len(other))]
    if shared:
        found += [100 * 2 * len(shared) / (2 * len(shared) + 1 + len(x)) for x in (own, other)]
    return max(found)


SENTENCES = (
    "kettle boils over", "Boils over: the kettle!", "over the hills", "Der Fluss trat über die Ufer", "die Ufer des Flusses", "über", "", "???",
    "meters taken for feet", "feet taken for metres", "wrong unit of length, twice", "цена без налога", "налог без цены", "a_b c-d", "c d a_b e",
)


def test_indel():
    r = random.Random(4)
    words = ["", "a", "flow", "wolf", "überfluss", *("".join(r.choice("abcé ") for _ in range(r.randrange(70))) for _ in range(40))]
    for a in words:
        b = r.choice(words)
        assert indel_distance(a, b) == indel_distance(b, a) == len(a) + len(b) - 2 * plain_lcs(a, b)
    assert ratio("", "") == 100 and ratio("ab", "") == 0


def test_token_set_ratio(spark):
    pairs = [(a, b) for a in SENTENCES for b in SENTENCES]
    got = with_token_set_ratio(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert len(got) == len(pairs) and all(r["score"] == pytest.approx(plain_set_ratio(r["a"], r["b"])) for r in got)


def test_dedup_decisions(spark):
    known = [(f"m{i}", t, i) for i, t in enumerate(SENTENCES)]
    new = [(1, "the kettle boils over again"), (2, "metres taken for feet once"), (3, "qqq zzz"), (4, "УЖЕ налог"), (5, None)]
    got = {r["new_id"]: (r["best_id"], r["decision"]) for r in G.dedup_check(spark.createDataFrame(new, "new_id int, cause string"), spark.createDataFrame(known, "id string, cause string, ord bigint")).collect()}
    for i, t in new:
        score, _, best = max((plain_set_ratio(t or "", k), -o, m) for m, k, o in known)
        decision = "blocked" if score >= 80 else "candidate" if score >= 50 else "allow"
        assert got[i] == (None if decision == "allow" else best, decision)
    assert {d for _, d in got.values()} == {"blocked", "candidate", "allow"}


def test_secrets(spark):
    key = "gh" + "p_" + "a1B2" * 6
    cases = {"api_key: abcdefgh1": True, "DB_PASSWORD=hunter2hunter": True, "postgres://user:pw123@host/db": True, "https://example.com/a:b": False, f"```\n{key}\n```\n": False, f"~~~\n{key}\n~~~\n": False, f"``` {key}\nx\n```\n": True, f"x {key}": True, "plain text": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["h"]["by_key"] or r["h"]["by_value"] > 0 for r in df.select("t", X.secret_hits(F.col("t")).alias("h")).collect()}
    assert got == cases


def test_ignore_patterns(spark):
    df = spark.createDataFrame([("seeds/a/b.md",), ("x.md",), ("seeds/keep.md",)], "p string")
    rules = ["**", "seeds/**", "!seeds/keep.md"]
    assert [r["i"] for r in df.select(G.ignored(F.col("p"), rules).alias("i")).collect()] == [True, False, False]


def test_frontmatter():
    head = "\ufeff---\r\nname: \"First\"\r\ntags:\r\n  - 'one'\r\n- two\r\nno key here\r\n- not an item\r\nnote: >\r\n  name: inner\r\n: nothing\r\nname: it's \"Last\"\r\n"
    fm, body = files.split_frontmatter(head + "---\t\r\n\n body\n---\nmore \n")
    assert fm == {"name": "it's \"Last", "tags": "one, two", "note": ">"} and body == "body\n---\nmore"
    assert files.split_frontmatter("---\nname: open\n") == ({}, "---\nname: open")
    assert files.split_frontmatter("text\n---\na: b\n---\n") == ({}, "text\n---\na: b\n---")
    assert files.split_frontmatter("---\n---\n") == ({}, "") and files.split_frontmatter("") == ({}, "")


def test_lists(spark):
    cases = {"[p, \"q r\", 's']": ["p", "q r", "s"], " t ,, u\n": ["t", "u"], "lone": ["lone"], "": [], "[]": [], "[ ]": [], "\u00a0x\t,\"\"": ["x"], "[a]b]": ["a]b"]}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["x"] for r in df.select("v", X.parse_list(F.col("v")).alias("x")).collect()} == cases


def test_read_facts_and_log(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nname: A\nkeywords: [k, 'l']\nrecurrence: 2\n---\nhello")
    (tmp_path / "MEMORY.md").write_text("index")
    row = files.read_facts(spark, str(tmp_path), "p").collect()
    assert len(row) == 1 and row[0]["keywords"] == ["k", "l"] and row[0]["recurrence"] == 2 and row[0]["body"] == "hello"
    (tmp_path / "w.log").write_text("# h\n2026-01-01|inject|a|s|x\n\nshort|x\n")
    got = L.scan(files.read_log(spark, str(tmp_path / "w.log"))).collect()
    assert [(r["line_no"], r["session"]) for r in got] == [(2, "s|x")]


def test_transcripts(spark):
    lines = [
        ("s", 1, '{"type":"user","timestamp":"2026-01-01T00:00:00Z","message":{"content":"plain"}}'),
        ("s", 2, '{"type":"assistant","timestamp":"2026-01-01T00:01:00Z","message":{"content":[{"type":"text","text":"one"},{"type":"tool_use"}]}}'),
        ("s", 3, "{broken"),
        ("s", 4, '{"type":"user","timestamp":"2026-01-01T00:03:00Z","message":{"content":[{"type":"tool_result","is_error":true}]}}'),
        ("s", 5, '{"type":"assistant","message":{"content":[{"type":"text","text":"two"}]}}'),
    ]
    df = spark.createDataFrame(lines, "session string, line_no bigint, value string")
    assert B.transcript_text(df).first()["text"] == "one\n\ntwo"
    assert B.transcript_metrics(df).first().asDict() == {"session": "s", "tool_calls": 1, "errors": 1, "seconds": 120}


def test_frontmatter_of_a_column(spark):
    """As the plain form has it, and no text below the block is sent to Python."""
    heads = ["", "\ufeff", "---\n", "\ufeff---x\r\na: 𝄞\r\n", "---\nname: b\nl:\n  - 'x'\n", "--\n", " ---\n"]
    ends = ["", "---", "---\n", "--- \t\r\n", "---x\n", " ---\n", "---\n---\n"]
    tails = ["", "body", "\u00a0\x1c\n body\u2003𝄞 \n---\nk: v\n\x1f", "line\n" * 30000]
    texts = [h + e + t for h in heads for e in ends for t in tails] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["p"]["fm"], r["p"]["body"]) for r in df.select("i", files.parse_frontmatter(F.col("t")).alias("p")).collect()}
    assert got == {i: files.split_frontmatter(t or "") for i, t in enumerate(texts)}
    plan = df.select(files.parse_frontmatter(F.col("t")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_keys_of(" in plan and "_keys_of(t" not in plan and "_keys_of(coalesce" not in plan, plan


def test_classify(spark):
    d = spark.createDataFrame([("s", "slug-a.md", "Nm", ["Did It"]), ("s", "b.md", "", [""]), ("t", "c.md", "c", [])], "session string, slug string, name string, evidence array<string>")
    t = spark.createDataFrame([("s", "we did it here")], "session string, text string")
    assert {r["slug"]: r["useful"] for r in B.classify(t, d).collect()} == {"slug-a.md": True, "b.md": False, "c.md": False}


def test_promote(spark):
    lines = [f"2026-01-0{i}|trigger-useful|always|s{i}" for i in range(1, 6)] + [f"2026-01-0{i}|trigger-silent|dud|s{i}" for i in range(1, 6)] + ["2026-01-01|ablate-start|done:3|cli"]
    lines += [f"2026-01-02|holdout-{k}|done|s{i}" for i in range(3) for k in ("skip", "hit")]
    f = facts(spark, [{"slug": "repeat.md", "type": "mistake", "recurrence": 3}, {"slug": "always.md"}, {"slug": "done.md"}, {"slug": "dud.md", "status": "candidate"}, {"slug": "quiet.md"}])
    got = {r["slug"]: r["kind"] for r in A.promote(f, log(spark, "\n".join(lines))).collect()}
    assert got == {"repeat": "mechanical", "always": "claudemd", "done": "retire", "dud": "retire"}


def test_replay_prefers_history(spark):
    lines = [f"2026-04-01|inject|hot|s{i}" for i in range(9)] + [f"2026-04-01|inject|c{i:02}|s" for i in range(20)] + ["2026-04-05|trigger-useful|hot|e1"]
    got = {r["k"]: r["recall"] for r in A.ab_replay(log(spark, "\n".join(lines)), ks=(1, 3)).collect()}
    assert got == {1: 1.0, 3: 1.0}


def test_decay_by_slug(spark):
    p = spark.createDataFrame([("a", "p", "note", "active", "2026-01-01", None), ("a", "q", "decision", "active", "2026-03-30", None), ("b", "p", "project", "active", "2020-01-01", None)], "slug string, project string, type string, status string, created string, last_injected string")
    loose = {(r["slug"], r["project"]): r["status"] for r in P.mark_stale(p, "2026-04-01").collect()}
    assert loose == {("a", "p"): "stale", ("a", "q"): "stale", ("b", "p"): "active"}
    assert {(r["slug"], r["project"]): r["status"] for r in P.mark_stale(p, "2026-04-01", strict_keys=True).collect()}[("a", "q")] == "active"


def test_cap_body_keeps_characters_whole(spark):
    df = spark.createDataFrame([("тест" * 10,), ("short",)], "b string")
    got = [r["x"] for r in df.select(X.cap_body(F.col("b"), 11).alias("x")).collect()]
    assert got == ["тестт\n\n…(truncated)", "short"]


def test_root_cause_and_native(spark):
    df = spark.createDataFrame([('a\nroot-cause: "long enough | cause"\n',), ("root-cause: short",), ("root-cause: |\n  a block of text",), ("root-cause:\nspans the next line",)], "t string")
    assert [r["x"] for r in df.select(X.root_cause(F.col("t")).alias("x")).collect()] == ["long enough | cause", None, None, "spans the next line"]
    f = spark.createDataFrame([("my-fact.md", "", "", "note", "", "", "# Title\nbody")], "slug string, name string, description string, type string, root_cause string, prevention string, body string")
    assert M.to_native(f).first()["content"] == '---\nname: "My fact"\ndescription: "Title"\ntype: note\n---\n# Title\nbody\n'


def test_stream_equals_batch(spark, tmp_path):
    text = "\n".join(["2026-04-01|inject|m|s1", "2026-04-02|recall|m|s2", "2026-04-03|outcome-positive|m|s3", "2026-04-04|inject-agg|n|7"])
    whole = log(spark, text)
    for i in range(2):
        whole.filter(F.col("line_no") % 2 == i).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fold.start_counters(stream, "folded", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    columns = ["key", "injects", "pos", "neg", "created", "last_inject"]
    assert sorted(map(tuple, spark.table("folded").select(columns).collect())) == sorted(map(tuple, L.aggregates(L.keyed(whole)).select(columns).collect()))


def test_shared_facts_are_classified_without_a_text_per_row(spark):
    """Each session with all facts of its share: as the plain form has it, and no row of a fact takes a text along."""
    r = random.Random(3)
    pieces = ["did it", "Élan", "k1", "k12", "fix 𝄞 note", "x", "a longer phrase than the windows are", "no"]
    texts = [(f"c{i}", " ".join(r.choice(pieces) for _ in range(r.randrange(6))).upper()) for i in range(30)] + [("c30", "ab" * 70000 + "fix 𝄞 note" + "ba" * 70000), ("c31", None)]
    sessions = [(f"c{i}", i % 3) for i in range(34)] + [("c40", 9)]
    facts = [(i % 4, f"k{i}.md", r.choice([*pieces, "", None]), r.choice([[r.choice(pieces)], [""], [], [r.choice(pieces), None], None])) for i in range(60)] + [(0, ".md", "", [])]
    t, c = spark.createDataFrame(texts, "session string, text string"), spark.createDataFrame(sessions, "session string, share bigint")
    f = spark.createDataFrame(facts, "share bigint, slug string, name string, evidence array<string>")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    got = B.classify_shared(t, c, f)
    want = rows(B.classify(t, c.join(f, "share").select("session", "slug", "name", "evidence")))
    assert rows(got) == want and 0 < sum(u for *_, u in want) < len(want)
    d = spark.createDataFrame([("c0", 1)], "session string, errors bigint").selectExpr("session", "errors", "errors AS tool_calls", "errors AS seconds")
    all_facts = f.withColumn("status", F.lit("candidate"))
    assert rows(B.close_events(got, all_facts, d, "2024-01-01", B.useful_shared(t, c, f))) == rows(B.close_events(got, all_facts, d, "2024-01-01"))
