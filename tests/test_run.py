import json

import pytest

from tests.test_markdown import docx
from themeloom.plans.knowledge import open_store, search
from themeloom.plans.run import Analysis, run_all, run_stage
from themeloom.plans.stage1 import stage1, topic_responses
from themeloom.settings import Settings
from themeloom.sources.results import read_stage1, read_stage1_successes

QUICK = Settings(kmeans_seeds=(42, 43), chunk_words=20, chunk_overlap=5)


def paragraph(words):
    return f"<w:p><w:r><w:t>{words}</w:t></w:r></w:p>"


@pytest.fixture()
def folder(tmp_path):
    docs = tmp_path / "documents"
    docs.mkdir()
    for i in range(6):
        subject = "garden flower soil water" if i % 2 else "engine motor wheel brake"
        body = "".join(paragraph(f"{subject} part {n} of talk {i}.") for n in range(4))
        (docs / f"talk_{i}.docx").write_bytes(docx(body))
    (docs / "broken.docx").write_bytes(b"no zip")
    return tmp_path


def test_all_stages_from_word_files(spark, folder):
    job = Analysis(str(folder / "documents"), str(folder / "results"), settings=QUICK)
    outcome = run_all(spark, job)
    assert [(stage, ok) for stage, ok, _ in outcome] == [
        ("convert", True), ("knowledge", True), ("stage1", True), ("stage2", True),
    ]
    summaries = {stage: summary for stage, _, summary in outcome}
    assert {r["error"] is None: r["rows"] for r in summaries["convert"].collect()} == {True: 6, False: 1}
    assert summaries["knowledge"].first()["inserted"] == 6
    first = summaries["stage1"].first()
    assert (first["total_articles"], first["failed_articles"]) == (7, 1)
    second = summaries["stage2"].first()
    assert second["articles_with_themes"] == 6 and second["n_clusters"] == 2
    records = read_stage1(spark, job.results)
    assert records.count() == 7
    assert read_stage1_successes(spark, job.results).count() == 6
    members = spark.read.json(f"{job.results}/stage2_members").collect()
    halves = {}
    for r in members:
        halves.setdefault(r["cluster_number"], set()).add(int(r["filename"][5]) % 2)
    assert sorted(map(tuple, halves.values())) == [(0,), (1,)]
    store = open_store(spark, "filename", job.store)
    for mode in ("local", "global", "hybrid", "vector"):
        best = search(store, "flower garden", mode, QUICK).first()
        assert int(best["filename"][5]) % 2 == 1, mode
    with pytest.raises(ValueError):
        search(store, "x", "other")


def test_markdown_folder_skips_conversion_and_callers_functions_are_used(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"a{i}.md").write_text(f"text {i}")

    def respond(prompt):
        if "themes" in prompt and "Topics:" in prompt:
            return '{"themes": [{"name": "T", "description": "d", "strength": 8}]}'
        if "Interview:" in prompt:
            if "text 3" in prompt:
                raise RuntimeError("no credit")
            topic = {"name": "same", "description": "same words here", "importance": 7}
            return json.dumps({"topics": [topic] * 3})
        return "not json"

    job = Analysis(
        "unused", str(tmp_path / "r"), str(tmp_path), QUICK, respond,
        lambda texts: [[float(len(t)), 1.0] for t in texts],
    )
    outcome = run_all(spark, job)
    assert [(s, ok) for s, ok, _ in outcome] == [("knowledge", True), ("stage1", True), ("stage2", True)]
    rows = {r["filename"]: r for r in read_stage1(spark, job.results).collect()}
    assert rows["a3.md"]["error"] == "no credit"
    assert (rows["a0.md"]["topics_count"], rows["a0.md"]["clustered_count"]) == (3, 1)
    assert rows["a0.md"]["clustered_topics"][0]["cluster_size"] == 3
    clusters = spark.read.json(f"{job.results}/stage2_clusters").collect()
    assert {r["error"] for r in clusters} == {"json_parse_failed"}
    assert {r["display_name"] for r in clusters} <= {"Cluster 0", "Cluster 1"}


def test_prompts_cover_whole_articles_and_their_topics_go_on(spark):
    """Text after the first window reaches a prompt; one failed window fails its article."""
    long = "".join(f"{i:04d} word " for i in range(50))
    rows = [("long", long, 100, None), ("bad", long + "poison", 101, None), ("short", "0007 word", 2, None), ("empty", "", 0, None)]
    articles = spark.createDataFrame(rows, "article string, content string, word_count long, error string")

    def respond(prompt):
        part = prompt.split("Interview:\n")[1].split("\n\nAnswer with")[0]
        if "poison" in part:
            raise RuntimeError("refused")
        return json.dumps({"topics": [{"name": part, "description": f"about {part}"}] if part else []})

    settings = Settings(content_cap=200, similarity_threshold=2.0)
    answers = topic_responses(articles, "article", settings, respond)
    assert answers.where("article = 'long'").count() == 3
    got = {r["article"]: r for r in stage1(articles, "article", settings, answers).collect()}
    assert "".join(t["name"] for t in got["long"]["original_topics"]) == long
    assert [t["name"] for t in got["short"]["original_topics"]] == ["0007 word"]
    assert got["bad"]["error"] == "refused" and not got["bad"]["topics_count"]
    assert got["empty"]["error"] is None and got["empty"]["topics_count"] == 0


def test_files_of_one_stem_are_one_article(spark, folder):
    job = Analysis(str(folder / "documents"), str(folder / "results"), settings=QUICK)
    (folder / "documents" / "talk_0.doc").write_bytes(b"old form")
    outcome = dict((stage, (ok, summary)) for stage, ok, summary in run_all(spark, job, ("convert", "stage1")))
    assert outcome["convert"][1].where("error is null").first()["rows"] == 6
    first = outcome["stage1"][1].first()
    assert (first["total_articles"], first["failed_articles"]) == (7, 1)
    records = read_stage1(spark, job.results).where("filename = 'talk_0.md'").collect()
    assert len(records) == 1 and records[0]["error"] is None


def test_run_stops_at_first_failed_stage(spark, tmp_path):
    (tmp_path / "only.md").write_text("one article about rivers")
    job = Analysis("unused", str(tmp_path / "r"), str(tmp_path), QUICK)
    outcome = run_all(spark, job, ("stage1", "stage2"))
    assert [ok for _, ok, _ in outcome] == [True, False]
    assert "Insufficient" in outcome[1][2]
    ok, reason = run_stage(spark, Analysis("missing", str(tmp_path / "x")), "convert")
    assert not ok and isinstance(reason, str)


def test_stage1_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(
        [(i, f"alpha beta {i % 3}\nbeta gamma\ndelta {i}\nalpha beta {i % 3}", 4, None) for i in range(12)],
        "id int, content string, word_count long, error string",
    )
    one = sorted(map(str, stage1(df.coalesce(1), "id").collect()))
    many = sorted(map(str, stage1(df.repartition(7), "id").collect()))
    assert one == many


def test_only_builtin_heading_styles_are_renamed():
    from xml.etree import ElementTree

    from themeloom.sources.word import NS, _style_names

    space = NS.strip("{}")
    given = ["heading 1", "heading 9", "heading red", "HEADING 1", "heading 10"]
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{v}"/></w:style>' for i, v in enumerate(given))
    names, default = _style_names(ElementTree.fromstring(f'<w:styles xmlns:w="{space}">{styles}</w:styles>'))
    assert list(names.values()) == ["Heading 1", "Heading 9", "heading red", "HEADING 1", "heading 10"]
    assert default == "Normal"
