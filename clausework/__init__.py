"""Review of large document collections as DataFrame jobs."""
