"""Security-event analytics on Spark: features, anomaly scores, evaluation and incidents."""

from eventlens.config import IncidentRules
from eventlens.operators.detector import Detector
from eventlens.operators.ensemble import Ensemble
from eventlens.plans.detection import Detection, detect
from eventlens.session import configure

__all__ = ["Detection", "Detector", "Ensemble", "IncidentRules", "configure", "detect"]
