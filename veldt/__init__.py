"""veldt: analytics operators written on the public DataFrame, SQL and Structured Streaming APIs."""
