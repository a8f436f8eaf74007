from difflib import SequenceMatcher

from ledgerline.plans.queries import score_code_similarity


def test_turns_are_scored_whole(spark, tmp_path):
    late = "# note\n" * 400 + "return total + 1"  # the first line that counts begins after character 2,000
    gold = "return total + 1"
    long_gold = "".join(chr(97 + i * 7 % 26) for i in range(2500)) + "tail" * 50
    rows = [(1, 0, "user", gold), (1, 1, "assistant", late), (2, 0, "user", long_gold), (2, 1, "assistant", long_gold[:2300] + "x" * 300)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.similarity for r in score_code_similarity(spark, str(tmp_path)).collect()}
    ratio = lambda a, b: round(100 * SequenceMatcher(None, a, b).ratio()) / 100
    assert got == {1: 1.0, 2: ratio(long_gold[:2300] + "x" * 300, long_gold)}
    assert got[2] != ratio(long_gold[:2000], long_gold[:2000])
