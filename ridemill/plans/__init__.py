"""Assembled jobs: the load pipeline, the view catalog and the registered queries."""
