"""Reading uploaded files, keeping batches, writing results."""
