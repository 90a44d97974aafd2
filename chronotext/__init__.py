"""chronotext: stylometric dating of text corpora as Spark DataFrame jobs.

Documents are cleaned, segmented and annotated as DataFrames; stylometric
feature families are long-form ``(doc_id, fset, term, value)`` tables;
selection (chi2), oversampling (DRO) and evaluation are joins, aggregations
and windows planned by Catalyst; models are Spark ML estimators.
"""

from chronotext.config import Config

__all__ = ["Config"]
__version__ = "0.1.0"
