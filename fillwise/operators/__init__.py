"""Questions over the analytic tables, each a lazy DataFrame transformation."""
