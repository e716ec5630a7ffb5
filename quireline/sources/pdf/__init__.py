"""PDF files: objects, cross references, pages, outlines, and incremental updates that add an outline."""
