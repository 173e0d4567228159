"""The queries over the reference's own operators: importing their modules registers them."""

from plumbline.plans import queries_checks, queries_directives, queries_packs, queries_plans, queries_spaces, queries_verified  # noqa: F401
from plumbline.operators import queries_evaluation, queries_footprints, queries_images, queries_layouts, queries_more, queries_relational, queries_rounds, queries_scene, queries_sequence, queries_spatial, queries_text  # noqa: F401
from plumbline.registry import ORACLES, QUERIES  # noqa: F401
from plumbline.sources import queries_sinks, queries_sources  # noqa: F401
from plumbline.streaming import queries_jobs, queries_streaming  # noqa: F401
