import pytest
from helpers import sample_events

from eventlens import detect
from eventlens.config import enabled_families, family_seconds, scope_seconds, tfidf_options
from eventlens.operators.features import BASIC, FAMILIES


def test_switches():
    config = {"features": {"user_behavior": {"enabled": False}, "window_size": 60}, "advanced_features": {"text_features": {"enabled": False}}}
    assert set(FAMILIES) - set(enabled_families(config, FAMILIES)) == {"user", "text"}
    assert enabled_families(None, BASIC) == list(BASIC)
    assert scope_seconds(config) == 60 and scope_seconds({}) == 3600


def test_windows_and_terms():
    assert family_seconds({"features": {"network_traffic": {"window_size": 30}}})["network"] == 30
    assert family_seconds(None) == {"user": 3600, "network": 300, "syscall": 60, "cmdline": 3600}
    assert tfidf_options({"advanced_features": {"tfidf_max_features": 7}}) == {"max_features": 7}
    text = {"max_features": 50, "stop_words": "english", "ngram_range": [1, 2]}
    assert tfidf_options({"feature_extraction": {"text_features": text}}) == {"max_features": 50, "ngrams": (1, 2)}
    assert tfidf_options({"feature_extraction": {"text_features": {"stop_words": None}}}) == {"max_features": 100, "stop_words": []}
    for bad in ({"stop_words": "klingon"}, {"ngram_range": [2, 1]}):
        with pytest.raises(ValueError):
            tfidf_options({"feature_extraction": {"text_features": bad}})


def test_detect_takes_terms_from_the_settings(spark):
    text = {"max_features": 3, "stop_words": None, "ngram_range": [2, 2]}
    config = {"features": {"window_size": 86400 * 400}, "feature_extraction": {"text_features": text}}
    names = ["unique_commands", "command_tfidf_0", "command_tfidf_3"]
    found = detect(sample_events(spark), names=names, config=config, families=FAMILIES, failed_login="error").model.scaler
    assert found.means[1] > 0 and found.means[2] == 0
