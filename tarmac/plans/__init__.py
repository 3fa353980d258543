"""End-to-end flows that chain the operators: the ETL run and the dashboard pages."""
