"""The metric operators reproduce the published figures from the published matrix."""

from pyspark.sql import functions as F

from flowsieve.operators import metrics

LABELS = ["BENIGN", "BRUTE_FORCE", "DDOS-ICMP_FLOOD", "DDOS-PSHACK_FLOOD", "DDOS-RSTFINFLOOD",
          "FRAGMENTATION_ATTACK", "HTTP_FLOOD_ATTACK", "MALWARE", "MIRAI_BOTNET", "RECONNAISSANCE",
          "SLOWLORIS_ATTACK", "SPOOFING", "SYN_FLOOD_ATTACK", "TCP_FLOOD_ATTACK", "UDP_FLOOD_ATTACK", "WEB_ATTACK"]
MATRIX = [
    [1794, 144, 0, 0, 0, 1, 0, 15, 0, 364, 0, 430, 0, 0, 0, 251],
    [7, 11, 0, 0, 0, 0, 0, 0, 0, 12, 0, 8, 0, 0, 0, 2],
    [0, 0, 2996, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 4, 0],
    [0, 0, 0, 2884, 0, 0, 0, 0, 1, 0, 12, 1, 13, 37, 52, 0],
    [0, 0, 0, 0, 2994, 0, 1, 0, 0, 1, 1, 0, 0, 0, 3, 0],
    [0, 0, 1, 0, 0, 2606, 0, 2, 3, 2, 18, 1, 0, 40, 42, 0],
    [0, 0, 0, 1, 0, 1, 241, 0, 1, 0, 12, 0, 3, 8, 8, 0],
    [0, 2, 0, 0, 0, 0, 0, 0, 0, 4, 0, 3, 0, 0, 0, 1],
    [0, 0, 0, 0, 0, 1, 1, 0, 2970, 0, 10, 0, 0, 2, 16, 0],
    [252, 150, 1, 0, 0, 0, 1, 12, 0, 1066, 1, 197, 0, 0, 0, 243],
    [0, 0, 0, 1, 0, 0, 5, 0, 0, 0, 33, 0, 0, 1, 13, 0],
    [277, 42, 0, 0, 0, 0, 0, 2, 1, 160, 1, 718, 0, 0, 0, 114],
    [0, 0, 0, 0, 0, 1, 7, 0, 0, 0, 1, 0, 2986, 0, 5, 0],
    [0, 0, 0, 0, 0, 1, 4, 0, 0, 0, 2, 0, 0, 2992, 1, 0],
    [0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 2, 0, 0, 0, 2996, 0],
    [10, 2, 0, 0, 0, 0, 0, 0, 0, 13, 0, 10, 0, 0, 0, 13],
]
EXPECTED = {
    "accuracy": 0.8986766739087497,
    "precision_weighted": 0.9213097270192243, "precision_macro": 0.6998061432368494,
    "recall_weighted": 0.8986766739087497, "recall_macro": 0.727660853803987,
    "f1_weighted": 0.9081763980307835, "f1_macro": 0.6976184075641552,
}


def test_gold_matrix_metrics(spark):
    cells = [(LABELS[i], LABELS[j], c) for i, row in enumerate(MATRIX) for j, c in enumerate(row) if c]
    preds = spark.createDataFrame(cells, "y string, yhat string, n int").select(
        "y", "yhat", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("one"))
    got = metrics.metrics(preds, []).first().asDict()
    assert got["test_set_size"] == 30378
    for k, v in EXPECTED.items():
        assert abs(got[k] - v) < 1e-12, (k, got[k], v)
    cm = metrics.confusion_matrix(preds, [])
    assert cm.count() == 256
    assert {(r["true_id"], r["pred_id"]): r["n"] for r in cm.collect()} == {
        (i, j): MATRIX[i][j] for i in range(16) for j in range(16)}
