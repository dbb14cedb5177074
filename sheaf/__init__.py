"""sheaf: document collections as Spark tables.

The operators work on whole DataFrames and keep errors as data; see
README.md for the inventory. Everything is importable from here:

    from sheaf import get_session, paginate, run_jobs, check_pipelines
"""

from .operators.backend import apply_backend
from .operators.extract import (apply_image_mode, chunk_errors, extract_html, extract_markdown,
                                parse_chunks, structure_blocks, structure_json)
from .operators.ledger import (cancel_events, cancel_jobs, decode_results, events_as_ledger, get_jobs,
                               job_state, list_jobs, register_jobs)
from .operators.pages import (merge_documents, page_counts, paginate, plan_previews, preview_pages,
                              preview_sizes, route_conversion, route_summary)
from .operators.scan import (classify_scan_responses, scan_corpus, scan_disabled, scan_gate, scan_hashes,
                             scan_hits, threat_counts)
from .operators.validate import (check_convert_requests, check_destinations, check_job_requests,
                                 check_merge_requests, check_pipelines, check_refs, check_urls, url_hosts)
from .plans.workflow import (JobRun, artifact_refs, assemble_results, checked_jobs, dispatch_ops, downloads,
                             file_names, first_submissions, job_outcome, latest_progress, op_status,
                             progress_events, progress_reports, run_jobs, unused_inputs)
from .session import checkpoint_root, get_session
from .sources.files import cap_sizes, files_from_documents, files_from_pages, read_files, read_table
from .sources.jobs import Jobs, explode_jobs, parse_jobs, read_jobs
from .sources.sinks import upload_plan, write_artifacts, write_structure
from .streaming.jobs import dedup_ledger, read_job_state, stream_job_state, stream_jobs, stream_table

__all__ = [name for name in dir() if not name.startswith("_")]
