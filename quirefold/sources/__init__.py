"""Reading documents: file inspection, engines and their adapters."""
