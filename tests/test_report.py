from convsift.operators.report import (NO_MATCHES, NO_TRACE_MATCHES, format_matches, format_traces,
                                       match_entries, trace_entries)

MATCH = ("ses_1", "Title A", 1706745600000, "message", "storage", "a storage module", "msg_1", "p_1", "/proj")
MATCH_COLS = ("session_id string, session_title string, timestamp long, match_type string, excerpt string, "
              "context string, message_id string, part_id string, project_directory string")
TRACE_COLS = ("session_id string, session_title string, timestamp long, first_touch boolean, "
              "user_prompt string, tool_name string, file_path string")


def test_empty_reports(spark):
    assert format_matches(spark.createDataFrame([], MATCH_COLS)) == NO_MATCHES
    assert format_traces(spark.createDataFrame([], TRACE_COLS)) == NO_TRACE_MATCHES


def test_match_report_text(spark):
    df = spark.createDataFrame([MATCH], MATCH_COLS)
    assert format_matches(df) == (
        "Found 1 matches in conversation history:\n\n"
        "## Title A\n- Session ID: ses_1\n- Project: /proj\n- Date: 2024-02-01 00:00:00\n"
        "- Match Type: message\n- Excerpt: \"storage\"\n- Context: ...a storage module...\n")


def test_context_line_omitted_when_equal_or_empty(spark):
    rows = [MATCH[:5] + ("storage",) + MATCH[6:], MATCH[:5] + ("",) + MATCH[6:]]
    for e in match_entries(spark.createDataFrame(rows, MATCH_COLS)).collect():
        assert "Context" not in e.entry
        assert e.header == "Found 2 matches in conversation history:"


def test_trace_report_text(spark):
    rows = [("ses_a", "T", 1706745600000, True, "build it", "write", "src/a.ts"),
            ("ses_b", "U", 1706745600000, False, None, None, "src/a.ts")]
    text = format_traces(spark.createDataFrame(rows, TRACE_COLS))
    assert text == (
        "Found 2 file trace matches in conversation history:\n\n"
        "## T\n- Session ID: ses_a\n- Date: 2024-02-01 00:00:00\n- Status: First seen\n- File: src/a.ts\n"
        "- Tool: write\n- Preceding User Prompt: \"build it\"\n\n"
        "## U\n- Session ID: ses_b\n- Date: 2024-02-01 00:00:00\n- Status: Later touch\n- File: src/a.ts\n")
    assert trace_entries(spark.createDataFrame(rows, TRACE_COLS)).count() == 2
