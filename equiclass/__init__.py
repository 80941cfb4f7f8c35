"""equiclass: class rebalancing as lazy Spark DataFrame plans."""

from .functions.keys import hash_hex, uniform01
from .operators.classes import class_rows, class_table
from .operators.encode import nominal_index
from .operators.neighbors import nearest_neighbors
from .operators.oversample import oversample
from .operators.profile import (class_counts, class_profile, code_counts, compare_profiles,
                                feature_stats, vector_stats)
from .operators.resample import resample_uniform
from .operators.sample import sample_bernoulli, sample_exact, sample_with_replacement
from .operators.smote import smote, smote_percent
from .operators.undersample import undersample_pair, undersample_spread
from .sources.readers import (format_labeled_vectors, parse_labeled_vectors, read_libsvm,
                              read_lines, read_table)

__all__ = [
    "hash_hex", "uniform01", "class_rows", "class_table", "nominal_index", "nearest_neighbors", "oversample",
    "class_counts", "class_profile", "code_counts", "compare_profiles", "feature_stats",
    "vector_stats", "resample_uniform", "sample_bernoulli", "sample_exact",
    "sample_with_replacement", "smote", "smote_percent", "undersample_pair", "undersample_spread",
    "format_labeled_vectors", "parse_labeled_vectors", "read_libsvm", "read_lines", "read_table",
]
