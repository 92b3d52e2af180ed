"""The learners' tables are derived from the texts once."""
from tabprep.operators import encode as EN
from tabprep.plans import catalog as C


def test_scaler_and_folds_do_not_read_the_texts_again(spark, monkeypatch):
    seen = []
    fit = EN.NumericScaler.fit
    monkeypatch.setattr(EN.NumericScaler, "fit", lambda self, df, *a: seen.append(df.inputFiles()) or fit(self, df, *a))
    train, test = C._doc_split(spark, "/root/testdata/sf0.001")
    assert train.count() + test.count() == C.table(spark, "/root/testdata/sf0.001", "doc_feats").count()
    assert seen and not any("documents" in f for f in seen[0])
