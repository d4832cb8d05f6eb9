from quillwave.plans import textcheck as T


def _rows(spark, *bodies):
    return spark.createDataFrame([(i, f"docs/{i}.md", b) for i, b in enumerate(bodies)], "doc_id long, path string, body string")


def test_scan_leaves_folders_out(spark, tmp_path):
    for path in ("docs/a.md", "build/x.md", "app/.git/y", "app/src/z.kt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    files = T.scan(spark, f"file://{tmp_path}")
    assert sorted((r.path, r.body) for r in files.collect()) == [("app/src/z.kt",) * 2, ("docs/a.md",) * 2]
    assert sorted(r.path for r in T.existing(files).collect()) == ["app", "app/src", "app/src/z.kt", "docs", "docs/a.md"]


def test_sections_begin_at_the_first_place_of_the_heading(spark):
    df = _rows(spark, "## Summary \n  one \n\n## Next\nx", "see ## Summary here\n## Summary\ntwo", "## Other", "## Summary")
    got = df.select(T.section(df["body"], "## Summary")).collect()
    assert [r[0] for r in got] == ["one", "here", None, ""]


def test_links_in_code_do_not_count_and_rooted_ones_do(spark):
    df = _rows(spark, "[a](/x.md)", "`[a](../x.md)`", "```\n[a](b.md)\n```", "[a]( https://x ) [b](mailto:c) [d](#e)", "[a](b.md) and [c](d (e).md)")
    assert [r[0] for r in df.select(T.unsafe_links(df["body"])).collect()] == [1, 0, 0, 0, 2]


def test_paths_in_code_have_to_exist(spark):
    notes = _rows(spark, "`docs/0.md` `docs/` `docs/9.md` `a b/c.md` `~/x.md` `x:y/z.md` `docs/<id>.md` `plain.md` `src/**/a.kt`")
    assert [(r.doc_id, r.cited) for r in T.broken_paths(notes, notes).collect()] == [(0, "docs/9.md")]


def test_open_versions_in_their_tables_only(spark):
    body = '# 1.+\n[versions]\na = "1.+" # x\nb = "1"\nc="LATEST.release"\n[other]\nd = "1.+"\ne = { version = "2-SNAPSHOT" }'
    assert sorted((r.line_no, r.place, r.why) for r in T.dynamic_versions(_rows(spark, body)).collect()) == [(3, "entry", "range"), (5, "entry", "latest.release"), (8, "inline", "snapshot")]


def test_wrapper_and_manifest_and_plans(spark):
    wrapper = _rows(spark, "distributionUrl=https\\://x/gradle-8.5-bin.zip", "distributionUrl=https\\://x/gradle-8.5-rc-1-bin.zip", "a=b\nvalidateDistributionUrl = FALSE ")
    assert sorted((r.doc_id, r.problem) for r in T.wrapper_failures(wrapper).collect()) == [(1, "not pinned"), (2, "no url"), (2, "validation off")]
    manifest = _rows(spark, "RECORD_AUDIO <service x/>", "<service/>", 'RECORD_AUDIO FOREGROUND_SERVICE_MICROPHONE <service android:foregroundServiceType="a|microphone"/>')
    assert sorted((r.doc_id, r.problem) for r in T.manifest_failures(manifest).collect()) == [(0, "no microphone type"), (0, "no permission")]
    whole = "\n".join(f"{h}\nlong enough text" for h in T.PLAN_REQUIRED)
    plans = _rows(spark, "**Status:** draft", "**Status:** Active\n" + whole, "x", "**Status:** lost", "**Status:** done\n" + whole.replace("## Definition of Done\nlong enough text", "## Definition of Done\naccuracy of 99.1 %"))
    assert sorted((r.doc_id, r.problem) for r in T.plan_failures(plans).collect()) == [(2, "no status"), (3, "unknown status"), (4, "accuracy without both rates"), (4, "bare percentage")]
