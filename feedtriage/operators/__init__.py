"""DataFrame operators of the triage job."""
