"""Documentation-corpus analytics on Spark: projects, table-of-contents trees and topics as tables."""
