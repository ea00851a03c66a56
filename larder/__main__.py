from larder.cli import main

raise SystemExit(main())
