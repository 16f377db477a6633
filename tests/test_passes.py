"""How often the log is read."""

from rankspark.plans import catalog_training as T
from rankspark.sources.mapped import impressions

SF = "/root/testdata/sf0.001"


def test_model_rows_are_encoded_in_one_pass_over_the_log(spark, monkeypatch):
    log = impressions(spark, SF).where("split <> 'test'")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(T, "impressions", lambda *_: log.mapInArrow(count, log.schema))
    encoded = T._model_rows(spark, SF)
    assert encoded.count() == log.count() == seen.value
    assert encoded.where("user_rate IS NULL OR video_rate IS NULL OR user_fid IS NULL OR dur_fid IS NULL").isEmpty()


def test_drawn_pairs_are_joined_to_their_rows_once(spark, monkeypatch):
    seen, drawn, draw = spark.sparkContext.accumulator(0), [], T.R.bpr_pairs

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def counted(*args, **kw):
        pairs = draw(*args, **kw)
        drawn.append(pairs)
        return pairs.mapInArrow(count, pairs.schema)

    monkeypatch.setattr(T.R, "bpr_pairs", counted)
    assert T.pairwise_ranker(spark, SF).first().fits
    assert seen.value == drawn[0].count()
